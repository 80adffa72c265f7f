"""Fill-in-middle outputs against a plain version, and rebuilt texts."""

import hashlib
import random
import re

from tests.llm.data import no_docs, odd_docs, prose
from tidelog.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_output(text, doc_id, seed, rate, spm_rate):
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None, None
    return (len(units), "spm", f"<S>{s}<P>{p}<M>{m}", p, m, s) if h[3] % 100 < spm_rate else (len(units), "psm", f"<P>{p}<S>{s}<M>{m}", p, m, s)


def check(docs, seed=42, rate=100, spm_rate=50):
    out = fim.transform(docs, seed, rate, spm_rate)
    col = {k: v.alias(k) for k, v in fim.parts(out["output"], out["form"]).items()}
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "output", *col.values(), fim.restore(out["output"], out["form"]).alias("restored")).collect()]
    want = [(r.doc_id, *plain_output(r.text, r.doc_id, seed, rate, spm_rate), r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return {r[2] for r in got}


def test_outputs_of_odd_rows(spark):
    for seed in (42, 7):
        assert check(odd_docs(spark), seed) == {"plain", "psm", "spm"}
    assert fim.transform(no_docs(spark), 1, 50, 50).count() == 0


def test_outputs_of_random_texts(spark):
    r = random.Random(3)
    alphabet = ["a", "é", "日", "𝄞", " ", "\n", "\x0b", " ", "\x00", "<", "P", "S", "M", ">", "$1", "\\", "{"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(600)]
    assert check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(k, "a b c d") for k in range(300)], "doc_id long, text string")
    assert check(docs, rate=0) == {"plain"}
    assert check(docs, spm_rate=100) == {"spm"} and check(docs, spm_rate=0) == {"psm"}


def test_very_long_texts(spark):
    texts = [prose(1, 400_000), " " * 2_000_000, "x" * 2_000_000, " \n" * 500_000 + "end", "<P>" * 100_000]
    check(spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string"))
