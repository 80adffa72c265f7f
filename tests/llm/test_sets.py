"""Token store, packing, chat format, decontamination, Jaccard join, pipeline: brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.data import ids_of, labels, no_docs, odd_docs, prose
from tests.oracle import same
from tidelog.llm import chat_format, decontaminate, ngram_join, packing, queries, token_store
from tidelog.llm.encode import Encoder, vocabulary

VOCABULARIES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
ODD = ["", " ", "a  b", "x\n y", " lead", "trail ", "it's don't 'S we'll", "naïve café́ é\tx", "日本 語 text.", "tab\tx y", "<|endoftext|> x", "ΑΣ ΣΑΣ", "x\x1cy z", "\r\n\r\n a", "a .b ,c  ...  d1 2e 33x", "ß! Ǆ? ﬁ, İ."]


@pytest.mark.parametrize("name, kind", VOCABULARIES)
def test_units_encode_as_whole_texts(name, kind):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    e = Encoder(vocabulary(name), kind)
    r = random.Random(5)
    noise = ["".join(r.choice("aB é.,'\n\t 1-ñß_日 ") for _ in range(60)) for _ in range(300)]
    for x in ODD + noise:
        assert e.encode([x])[0] == np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes(), x


def test_units_survive_a_full_memory(monkeypatch):
    from tidelog.llm import encode

    monkeypatch.setattr(encode, "BOUND", 20)
    small, big = Encoder(vocabulary("byte_bpe_50k.json"), "byte"), Encoder(vocabulary("byte_bpe_50k.json"), "byte")
    texts = [prose(k % 7, 30) + "." for k in range(30)]
    assert [small.encode([t])[0] for t in texts] == big.encode(texts)


def encoded(texts, name, kind):
    return [np.frombuffer(b, "<u4") for b in Encoder(vocabulary(name), kind).encode(texts)]


def test_token_store(spark):
    docs = odd_docs(spark)
    path = token_store.write(docs, vocabulary("byte_bpe_50k.json"))
    out = token_store.read(spark, path).collect()
    rows = docs.collect()
    ids = encoded([r.text for r in rows], "byte_bpe_50k.json", "byte")
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == sorted((repr(r.doc_id), len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    out.sort(key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in out]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    found = token_store.lookup(spark, path, spark.createDataFrame([(7,), (10,), (12345,)], "doc_id long")).collect()
    want = {(r.doc_id, x.tobytes()) for r, x in zip(rows, ids) if r.doc_id in (7, 10)}
    assert {(r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in found} == want
    assert token_store.read(spark, token_store.write(no_docs(spark), vocabulary("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_index_is_minimal_and_perfect(n):
    hashes = [token_store.key_hash(k, 0) for k in range(n)]
    seeds, slot = token_store.build_index(hashes)
    assert sorted(slot) == list(range(n))
    slots = np.zeros(n, token_store.SLOT)
    slots["fingerprint"][slot] = [h & 0xFFFFFFFF for h in hashes]
    slots["offset"][slot] = np.arange(n)
    assert all(token_store.find(seeds, slots, k)[0] == k for k in range(n))
    assert sum(token_store.find(seeds, slots, k) is not None for k in range(n, n + 1000)) == 0


def check_packed(rows, ids):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted((r.length, r.ids_crc32) for r in rows) == sorted((len(p), zlib.crc32(p.tobytes())) for x in ids for p in np.split(x, range(2048, len(x), 2048)))
    return len(bins)


def test_packing(spark):
    docs = odd_docs(spark)
    check_packed(packing.pack(docs, vocabulary("word_bpe_49k.json")).collect(), encoded([r.text for r in docs.collect()], "word_bpe_49k.json", "word"))
    assert packing.pack(no_docs(spark), vocabulary("word_bpe_49k.json")).count() == 0
    with_ids = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids.collect())


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_sequences(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = r.choice([r.randint(1, 2048), r.randint(1, 600), 2048, 1, 683, 1024])
        counts[n] = counts.get(n, 0) + 1
    used, placed = {}, {}
    for length, rank, count, first, offset in packing.plan(counts):
        assert rank == placed.get(length, 0)
        placed[length] = rank + count
        for k in range(count):
            used.setdefault(first + k, []).append((offset, length))
    assert placed == counts
    large = 0
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and sum(3 * n > 2048 for _, n in pieces) <= 2
        large += any(3 * n > 2048 for _, n in pieces)
    least = max(-(-sum(n * c for n, c in counts.items()) // 2048), sum(c for n, c in counts.items() if n > 1024))
    assert len(used) <= 1.03 * least + 1


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_event_log(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "a"), (1, 3, 1, "delta", None, "b"), (1, 4, 2, "message", "user", "more"), (1, 5, 3, "delta", "assistant", "x"),
        (1, 6, 0, "edit", None, "hello"), (1, 7, 1, "regenerate", "assistant", ""), (1, 8, 1, "delta", None, "c"), (1, 9, 1, "delta", None, None), (2, 1, 0, None, None, None),
    ]
    r = random.Random(1)
    r.shuffle(log)
    out = chat_format.fold_events(spark.createDataFrame(log, EVENTS))
    assert ids_of(out, "conv_id", "turn", "role", "text") == [(1, 0, "user", "hello"), (1, 1, "assistant", "c"), (2, 0, "", "")]


def plain_fold(log):
    """The messages that a log leaves: a regeneration drops its turn's and all later turns' events before it, other kinds but deltas begin a turn anew."""
    kept = []
    for e in sorted(log, key=lambda e: (e[0], e[2] or "message", e[3] is not None, e[3] or "", e[4] or "")):
        if (e[2] or "message") == "regenerate":
            kept = [x for x in kept if x[1] < e[1]]
        kept.append(e)
    out = {}
    for _, turn, kind, role, text in kept:
        old_role, old_text = out.get(turn, ("", ""))
        out[turn] = (role or old_role, old_text + (text or "") if kind == "delta" else text or "")
    return sorted((t, *v) for t, v in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_fold_as_a_plain_loop(spark, seed):
    r = random.Random(seed)
    logs = {c: [(k, r.randint(0, 6), r.choice(["delta", "delta", "edit", "message", "regenerate", None]), r.choice(["user", "assistant"]), r.choice(["a", "é", "", None])) for k in range(r.randint(1, 40))] for c in range(20)}
    rows = [(c, *e) for c, log in logs.items() for e in log]
    r.shuffle(rows)
    got = ids_of(chat_format.fold_events(spark.createDataFrame([(c, s, t, k, a, x) for c, s, t, k, a, x in rows], EVENTS)), "conv_id", "turn", "role", "text")
    assert got == sorted(((c, *m) for c, log in logs.items() for m in plain_fold(log)), key=repr)


def test_long_conversations_take_linear_time(spark):
    import time

    def took(n):
        events = spark.range(n).selectExpr("1L AS conv_id", "id AS seq", "id DIV 4 AS turn", "CASE id % 4 WHEN 0 THEN 'message' ELSE 'delta' END AS kind", "CASE id DIV 4 % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role", "repeat('xé', 5) AS text")
        began = time.time()
        row = chat_format.with_loss_text(chat_format.render(chat_format.fold_events(events))).collect()[0]
        assert len(row.loss) == n // 2 * 10 and len(row.loss_spans) == n // 8
        return time.time() - began

    took(2_000)
    short, long = took(20_000), took(80_000)
    assert long < 6 * short + 3


def test_template_is_reversible(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\<\\[\\\\", "<\\", "a\nb</s>\n<s>[user]\n", "]\n", "é😀"]
    rows = [(k // 3, k, ("user", "assistant", "a b]\n")[k % 3], t) for k, t in enumerate(texts * 2)]
    rows += [(None, None, None, None), (0, 0, "user", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.fold_events(chat_format.from_turns(conv)))
    from pyspark.sql import functions as F

    whole = chat_format.with_loss_text(out)
    assert whole.columns == ["conv_id", "formatted", "loss_spans", "loss"]
    got = whole.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), F.col("loss").alias("l"), "formatted", "loss_spans").collect()
    for r in got:
        for x in r.loss_spans:
            assert r.formatted[x.start : x.end] == r.formatted.encode()[x.first : x.last].decode()
        mine = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.t] == [(a, b) for _, a, b in mine]
        assert r.l == "".join(b for _, a, b in mine if a == "assistant")
    assert chat_format.render(chat_format.fold_events(chat_format.from_turns(conv.limit(0)))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def brute_hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = decontaminate.words_of(text), set(), set()
        for item, t in items:
            iw = decontaminate.words_of(t)
            n = min(window, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if wins and tuple(words[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
        out.append((repr(doc_id), len(words), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination(spark, monkeypatch):
    item = prose(50, 30)
    items = [(1, item), (1, item), (2, "Short One!"), (10, None), (11, ""), (None, prose(51, 10)), (3, prose(1, 80))]
    docs = odd_docs(spark)
    extra = [(100, prose(60, 20) + " " + item.upper() + " x", None, None, None, None, None, None), (101, " ".join(item.split()[5:16]), None, None, None, None, None, None), (102, "a short one b", None, None, None, None, None, None), (103, prose(51, 10), None, None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    for passes in (2_000_000, 40):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", passes)
        got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in decontaminate.judge(docs, bench).collect())
        assert got == want
    assert decontaminate.judge(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.judge(no_docs(spark), bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(1 for _, _, n, _ in want if n == 0)


def test_proximity(spark):
    item = [f"w{k}" for k in range(10)]
    moved = item[:5] + ["gap"] + item[5:]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(moved)), (3, " ".join(item[:5] + ["gap"] * 4 + item[5:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in decontaminate.judge(docs, bench, slop=slop).collect() if r.n_hit}
    assert (hit(0), hit(1)) == ({1}, {1, 2})


def brute_components(rows):
    """rows: (id, text); ids of rows and the smallest id of each component."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((repr(k), len(sets[i]), repr(least.get(root(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def near_copies(seed):
    r = random.Random(seed)
    texts = []
    for g in range(30):
        words = prose(seed * 100 + g, r.choice([3, 5, 6, 7, 9, 11, 14, 25, 60, 200])).split()
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(w))
                how = r.randrange(3)
                w[k : k + 1] = [] if how == 0 and len(w) > 1 else [w[k], "new"] if how == 1 else [f"x{r.randrange(50)}"]
            texts.append(" ".join(w))
    shared = prose(seed + 900, 60)
    texts += [shared + " " + prose(seed * 1000 + k, r.randint(8, 25)) for k in range(40)]
    return texts


@pytest.mark.parametrize("seed, long, hot", [(1, 32, 4096), (2, 2, 4096), (3, 2, 4), (4, 32, 4)])
def test_jaccard_join(spark, monkeypatch, seed, long, hot):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    rows = list(enumerate(near_copies(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((repr(r.doc_id), r.n, repr(r.component_id)) for r in ngram_join.components(docs).collect())
    assert got == brute_components(rows)


def test_jaccard_join_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((repr(r.doc_id), r.n, repr(r.component_id)) for r in ngram_join.components(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.components(no_docs(spark)).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.filter("text like '%e%' and doc_id in (4, 5)").collect()) == ["4"]
    assert kept.filter("doc_id in (0, 1, 2)").count() == 3


def test_needed_overlap():
    for a in range(1, 60):
        for b in range(1, 60):
            for c in range(min(a, b) + 1):
                assert (100 * c >= 80 * (a + b - c)) == (c >= ngram_join.needed(a, b))
            assert (ngram_join.needed(a, b) <= min(a, b)) == (b in ngram_join.sizes_linked(a))


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as cp

    docs, marks = [], []
    for k in range(160):
        bad = k % 5 == 0
        text = prose(k, 120, "aeioulmn" if k % 2 else "kzxwvqjp")
        docs.append((k, " ".join(w + "###" for w in text.split()) if bad else text, "aa" if k % 2 else "kk", "s", len(text)))
        marks.append((k, int(not bad), 0))
    copy = docs[1][1]
    item = prose(7000, 15)
    docs += [(500, copy, "aa", "s", 1), (501, copy + " end", "aa", "s", 1), (502, docs[3][1] + " " + item, "aa", "s", 1), (503, None, None, None, None), (504, "...", None, None, None), (1, copy, "aa", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, marks).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r.doc_id for r in at.collect())
    assert {503, 504}.isdisjoint(seen["language_id"]) and len(seen["language_id"]) == len(docs) - 2
    assert not any(k % 5 == 0 for k in seen["quality"] if k < 160) and set(k for k in range(160) if k % 5) <= set(seen["quality"])
    parts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "quality")).collect()}
    comps = {repr(c) for _, _, c in (eval(repr(x)) for x in brute_components(list(parts.items())))}
    assert len(seen["near_duplicates"]) == len(comps) and 500 not in seen["near_duplicates"]
    assert 502 not in seen["decontaminate"]
    packed = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert packed == set(seen["decontaminate"])


def test_token_store_tells_null_from_empty(spark):
    rows = [(None, "a b"), ("", "c"), ("x", "d e f"), ("", "g"), ("None", "h")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    path = token_store.write(docs, vocabulary("byte_bpe_50k.json"))
    assert sorted(repr(r.doc_id) for r in token_store.read(spark, path).collect()) == sorted(repr(k) for k, _ in rows)
    keys = spark.createDataFrame([(None,), ("",), ("None",), ("n",)], "doc_id string")
    found = token_store.lookup(spark, path, keys)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    want = [(k, encoded([t], "byte_bpe_50k.json", "byte")[0].tobytes()) for k, t in rows if k != "x"]
    assert sorted((repr(r.doc_id), np.array(r.ids, "<u4").tobytes()) for r in found.collect()) == sorted((repr(k), b) for k, b in want)


def test_token_store_of_one_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PART_KEYS", 4)
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 8)
    path = token_store.write(spark.range(30).selectExpr("7L as doc_id", "concat('t', id) as text"), vocabulary("byte_bpe_50k.json"))
    assert token_store.lookup(spark, path, spark.createDataFrame([(7,), (8,)], "doc_id long")).count() == 30


def test_index_of_equal_keys_fails(monkeypatch):
    monkeypatch.setattr(token_store, "SEEDS", 1000)
    with pytest.raises(ValueError):
        token_store.build_index([token_store.key_hash(1)] * 2)


def test_hashed_words():
    from tidelog.llm.text import HashedWords

    words = HashedWords()
    raws = [b"", b"a b\ta", b" \n", b"\xc3\xa9 x" + b"y" * 700_000 + b" a", b"b"]
    h, size = words.of(raws)
    split = [w for r in raws for w in r.split()]
    assert size.tolist() == [len(r.split()) for r in raws] and len(h) == len(split)
    assert len(dict(zip(split, h.tolist()))) == len(set(h.tolist())) == len(set(split))
    assert [words.of([w])[0][0] for w in split] == h.tolist()
    assert words.of([])[1].tolist() == [] and words.of([b""])[1].tolist() == [0]


@pytest.mark.parametrize("seed", range(4))
def test_forest_joins_what_all_pairs_join(seed):
    r = random.Random(seed)
    for _ in range(50):
        n = r.randint(2, 30)
        pairs = [(i, j) for i, j in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 80))) if i != j]
        kept = ngram_join.forest(np.arange(n), *(np.array([p[k] for p in pairs], int) for k in (0, 1)))

        def roots(pairs):
            parent = list(range(n))
            for i, j in pairs:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
            return parent

        every, some = roots(pairs), roots([pairs[k] for k in kept])
        assert every == some and len(kept) == n - len(set(every))


@pytest.mark.parametrize("seed, block", [(5, 2_000_000), (6, 60)])
def test_number_of_links(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    rows = list(enumerate(near_copies(seed))) + [(900, None), (901, "  ")]
    got = {r.doc_id: r.n_links for r in ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    want = {k: sum(j != k and 9 * len(a & b) >= 4 * (len(a) + len(b)) for j, b in sets.items() if a and b) for k, a in sets.items()}
    assert got == want and max(want.values()) > 5
    assert ngram_join.links(no_docs(spark)).count() == 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline as cp

    docs = [] if empty == "documents" else [(k, prose(k, 60, "aeioulmn" if k % 2 else "kzxwvqjp"), "aa" if k % 2 else "kk", "s", 1) for k in range(12)]
    marks = [] if empty == "labels" else [(k, 1, 0) for k in range(12)]
    items = [] if empty == "benchmark" else [(1, prose(99, 15))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, marks).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    # without labels no document is known to be good enough
    assert kept == (set(range(12)) if empty == "benchmark" else set())


def repetitive(n):
    """A word of n letters (a power of two) and its complement: polynomials mod 2**64 don't tell them apart from 512 on."""
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 64, 512, 4096])
def test_repetitive_words_are_told_apart(spark, n):
    from tokenizers import Tokenizer

    t, u = repetitive(n)
    for name, kind in VOCABULARIES:
        whole = Tokenizer.from_file(vocabulary(name)).encode(f"x {t} {u}", add_special_tokens=False).ids
        assert Encoder(vocabulary(name), kind).encode([f"x {t} {u}"])[0] == np.array([*whole, 0], "<u4").tobytes()
    docs = spark.createDataFrame([(1, f"{t} a b c d e f"), (2, f"{u} g h i j k l"), (3, t), (4, u)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.components(docs).collect()) == [(k, k) for k in (1, 2, 3, 4)]
