"""The catalogue of a folder: files of every size and state."""

import hashlib
import os

from tidelog.sources import files


def test_catalogue(spark, tmp_path):
    root = tmp_path / "root"
    (root / "etc" / "deep" / "er").mkdir(parents=True)
    (root / "none").mkdir()
    (root / "etc" / "passwd").write_bytes(b"x:y")
    (root / "empty").write_bytes(b"")
    (root / "etc" / "deep" / "er" / "ü ñ.bin").write_bytes(bytes(range(256)) * 9000)
    with open(root / "large", "wb") as f:  # more than any one value of Spark holds
        f.truncate((2 << 30) + 5)
    os.symlink("etc/passwd", root / "inside")
    os.symlink("nowhere", root / "broken")
    os.symlink("/etc/hostname", root / "outside")
    os.symlink("etc", root / "folder")
    os.mkfifo(root / "pipe")
    rows = {r.relative_path: r for r in files.catalogue(spark, f"file://{root}").collect()}
    assert {k: (r.status, r.size_bytes) for k, r in rows.items()} == {
        "etc/passwd": ("collected", 3), "empty": ("collected", 0), "etc/deep/er/ü ñ.bin": ("collected", 2304000), "large": ("collected", (2 << 30) + 5), "inside": ("collected", 3),
        "broken": ("broken_symlink", 0), "outside": ("out_of_bounds_symlink", 0), "folder": ("collected", 0), "pipe": ("unreadable", 0),
    }
    for k in ("etc/passwd", "empty", "etc/deep/er/ü ñ.bin", "inside"):
        content = (root / k).read_bytes()
        assert (rows[k].md5, rows[k].sha256, rows[k].sha512) == tuple(hashlib.new(n, content).hexdigest() for n in files.DIGESTS)
    assert rows["large"].md5 is not None and rows["folder"].md5 is None and rows["broken"].link_target == "nowhere" and rows["etc/passwd"].artifact_type == "passwd"
    assert files.catalogue(spark, str(root / "none")).count() == 0 and [r.status for r in files.catalogue(spark, str(root / "gone")).collect()] == ["unreadable"]


def test_files_that_cannot_be_read(tmp_path):
    def refused(error):
        def opened(path, mode):
            raise error

        return opened

    assert files.digests("x", refused(PermissionError("no"))) == {"md5": None, "sha256": None, "sha512": None, "status": "permission_denied", "error": "no"}
    assert files.digests("x", refused(OSError("broken disk")))["status"] == "unreadable"
    assert files.digests(str(tmp_path / "gone"))["status"] == "unreadable"
