"""Personal data, packing, and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillstone.llm import packing, pii

BPE = public_tokenizers.path("word_bpe_49k.json")
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow_seeds(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = ["a@b.c@d.e", "@a.b x@y", "x@@y.z a.b@c-d.e-f.g.", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "001.002.003.004", "4111-1111 1111-1111", "+1 (269) 555-3296 4111111111111111", "+12345678", "++1 23 456 789)", "é4111111111111111é", "1" * 40, "٣٤@x.y"]


@pytest.mark.parametrize("text", TRICKY)
def test_seeds(text):
    assert pii.joined(pii.seeds(text)) == slow_seeds(text)


def test_seeds_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000, "9 " * 100_000):
        pii.seeds(text)


def test_base_and_added_spans(spark, docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in pii.find(df).collect():
            want = slow_seeds(texts[r.doc_id])
            assert hashlib.sha256(want.encode()).hexdigest() == r.base_sha256
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k, _ in BASE]
    assert pii.find(no_docs).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"call me at +1 ({200 + i}) 555-{1000 + i} today") for i in range(40)] + [(99, "call me at +1 (999) 555-9999 4111111111111112 today"), (100, "version 10.20.30 of 2024")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "phone:11:28" and got[100] == "" and got[3] == "phone:11:28"


def test_context_discovers_unseen_forms(spark):
    seen = [(i, f"call me at +1 ({200 + i}) 555-{1000 + i} today, write to u{i}@x{i}.example.com soon, from host 10.0.{i}.7 there") for i in range(80)]
    found = {
        "(017) 555-7713": "phone", "017-555-7713": "phone", "06 12 34 56 78": "phone", "017.555.7713": "phone",
        "jane@b\u00fccher.example": "email", "2001:db8::17": "ip",
    }
    lead = {"phone": "call me at", "email": "write to", "ip": "from host"}
    rows = [(100 + i, f"{lead[k]} {x} at once") for i, (x, k) in enumerate(found.items())]
    more = [(200, "order 017-555-7713-2 of 2024"), (201, "call me at 5pm"), (202, "rows 1 2 3 4 5 6 7 8 9 10 11 12 13 of 017 555 7799"), (203, "from host 12:30:45 at once")]
    df = spark.createDataFrame(seen + rows + more, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for i, (x, k) in enumerate(found.items()):
        assert got[100 + i] == f"{k}:{len(lead[k]) + 1}:{len(lead[k]) + 1 + len(x)}", x
    assert [got[i] for i, _ in more] == [""] * 4
    assert [r.text for r in pii.redact(df).where("doc_id in (100, 105)").orderBy("doc_id").collect()] == ["call me at [PHONE] at once", "from host [IP] at once"]


def test_long_runs_are_few():
    assert len(pii.candidates("9 " * 20_000, [])) < 3 * 20_000 + 100


def test_forms_and_contexts_have_no_caps():
    long_mail = "a" * 150 + "@" + "b" * 150 + ".example.com"
    text = f"{'x' * 90} {'y' * 90} {long_mail} {'z' * 90}"
    (c,) = pii.candidates(text, [])
    assert c["surface"] == long_mail and f"l2 {'x' * 90} {'y' * 90} email" in c["patterns"] and f"r {'z' * 90} {pii.coarse(long_mail)}" in c["patterns"]
    many = " ".join(f"1.1.1.{i}" for i in range(30))
    assert all(not any(a < e and s < b for _, s, e in pii.seeds(many)) for a, b in ((c["start"], c["end"]) for c in pii.candidates(many, pii.seeds(many)) if c["seed"] < 0))
    assert pii.valid(3, "017.555.7713") and pii.valid(3, "+1 (269) 555-3296") and not pii.valid(3, "017      555 7713") and not pii.valid(3, "1+2345678901")


def slow_learning(rows, rounds, support, accept):
    """Scores of a small pattern-instance graph, from lists of candidates."""
    edges, seed = {}, {}
    for c in rows:
        for p in c["patterns"]:
            edges.setdefault(c["surface"], set()).add(p)
            seed[c["surface"], p] = max(seed.get((c["surface"], p), -1), c["seed"])
    first = {(s, k): 1.0 for (s, _), k in seed.items() if k >= 0}
    known = {s for s, _ in first}
    scores = dict(first)
    for _ in range(rounds):
        good = {}
        for p in {p for ps in edges.values() for p in ps}:
            members = [s for s, ps in edges.items() if p in ps]
            for k in range(4):
                if sum(seed[s, p] == k and (s, k) in scores for s in members) >= support:
                    confidence = sum(scores.get((s, k), 0.0) for s in members) / (len(members) + 1)
                    if confidence >= accept:
                        good[p, k] = confidence
        scores = dict(first)
        for s, ps in edges.items():
            for k in range(4):
                best = max((v for (p, j), v in good.items() if j == k and p in ps and seed[s, p] < 0), default=0)
                if best and s not in known:
                    scores[s, k] = best
    return {k: v for k, v in scores.items() if k[0] not in known and v < 1}


def test_learning_equals_a_plain_graph(spark, docs):
    rows = [(i, f"call me at +1 ({200 + i}) 555-{1000 + i} today, write to u{i}@x{i}.example.com soon") for i in range(60)] + [(90 + i, f"call me at 0{100 + i} 555 77{10 + i} today or {i}000 of 12 345") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    found = pii.scan(df).cache()
    cands = [c.asDict() for r in found.collect() for c in r.cands]
    got = {(r.surface, r.kind): r.score for r in pii.learn(found).collect()}
    want = slow_learning(cands, pii.ROUNDS, pii.SUPPORT, pii.ACCEPT)
    assert got.keys() == want.keys() and got and all(got[k] == pytest.approx(want[k]) for k in got)


def test_redaction(odd_docs, no_docs):
    assert pii.redact(no_docs).count() == 0
    clash = odd_docs.selectExpr("*", "1 as key", "2 as `row`", "3 as c1", "4 as __key")
    assert {tuple(r)[-4:] for r in pii.redact(clash).collect()} == {(1, 2, 3, 4)}
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[12].startswith("mail [EMAIL] or ") and "10.0.0.1" not in texts[12] and texts[1] is None and texts[2] == ""


# -- packing ---------------------------------------------------------------------------------------------------------


def check_pieces(rows, docs, window):
    tok = Tokenizer.from_file(BPE)
    ids = [(r.doc_id, np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in docs]
    known = {}
    for i, x in ids:
        known.setdefault(i, []).append(x)
    total = {}
    for r in rows:
        x = known[r.doc_id][0]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: sum(map(len, x)) for i, x in known.items()}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(total.values())


@pytest.mark.parametrize("window", [4096, 256])
def test_packing(spark, docs, window):
    rows = packing.pack(docs, BPE, window=window).collect()
    padding, size = check_pieces(rows, docs.collect(), window)
    assert padding < 0.02 * size + window


def test_packing_edge_cases(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs.where("doc_id is not null"), BPE).collect()
    docs = [r for r in odd_docs.where("doc_id is not null").collect()]
    check_pieces(rows, docs, 4096)
    assert packing.pack(no_docs, BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_left_over_once(seed):
    rnd = np.random.default_rng(seed)
    window = 512
    lengths = {0: rnd.integers(1, 512, 3000), 1: rnd.integers(300, 500, 500), 2: np.full(700, 301), 3: np.minimum(511, rnd.geometric(0.02, 5000))}[seed]
    counts = dict(zip(*np.unique(lengths, return_counts=True), strict=True))
    made = packing.plan({int(n): int(k) for n, k in counts.items()}, window, slack=2)
    used = {}
    for n, first, last, *_ in made["segments"]:
        used[n] = used.get(n, 0) + last - first
    for n, (first, k) in made["cut"].items():
        assert used.get(n, 0) == first
        used[n] = first + k
    assert used == {int(n): int(k) for n, k in counts.items()}
    assert made["sequences"] * window - lengths.sum() < 0.01 * lengths.sum() + window


def test_powers():
    assert packing.powers(13) == [8, 4, 1] and packing.powers(0) == []


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data, odd_docs):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, data).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before, name
    ids = sorted(r.doc_id for r in docs.collect())
    assert len(ids) == len(set(ids)) and 5 not in ids and 7 not in ids and 1 not in ids and 15 not in ids


def test_pipeline_stages_of_nothing(spark, data, no_docs):
    import corpus_pipeline

    docs = no_docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as key", "2 as `row`", "3 as __key", "4 as c0", "5 as id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == 0


def test_rows_without_id_are_packed(spark):
    df = spark.createDataFrame([(None, "some text of it", 1, 2), (None, None, 1, 2), (3, "some text of it", 1, 2)], "doc_id long, text string, rest int, part int")
    rows = packing.pack(df, BPE).collect()
    by = {}
    for r in rows:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert set(by) == {None, 3} and by[None] == by[3] + 1


def test_groups_are_of_texts_not_of_ids(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, one, "en", None, None), (None, two, "en", "s", 1), (5, three, "en", None, None), (5, four, "en", None, None), (7, three, "en", None, None), (None, four, "fr", None, None), (5, four, "en", None, None), (None, one, "en", None, None), (None, one, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as key", "2 as `row`", "3 as __key", "4 as id", "5 as `group`")
    got = corpus_pipeline.keep_one_of_each_group(spark, df, None).collect()
    assert {tuple(r)[-5:] for r in got} == {(1, 2, 3, 4, 5)}
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, one), (None, two), (5, three), (5, four)], key=str)


def test_pipeline_run(spark, data):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_tokenizing_holds_small_slices_and_few_chunks(monkeypatch):
    """Two workers share an executor's memory with the JVM: about a megabyte of text at once, and a table that grows in place."""
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    seen = []

    class Tokens:
        def run(self, texts):
            seen.append(sum(map(len, texts)))
            return np.zeros(len(texts), np.uint16), np.ones(len(texts), np.int64)

    made = []
    monkeypatch.setattr(packing, "text_rows", lambda docs: SimpleNamespace(mapInArrow=lambda run, schema: made.append(run)))
    monkeypatch.setattr(packing, "held", lambda key, make: Tokens())
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.tokenized(None, "")
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["x" * 100_000] * 40)], ["id", "text"])
    assert sum(b.num_rows for b in made[0](iter([batch]))) == 40
    assert sum(seen) == 4_000_000 and max(seen) <= 1_000_000


def test_chunk_table_grows_and_empties():
    from rillstone.llm.common import ChunkTable
    import numpy as np

    table = ChunkTable(lambda chunks: [[len(c), *c] for c in chunks], np.uint16, limit=2000)
    for i in range(40):
        chunks = [b"%d" % (k % (50 * i + 7)) for k in range(300)] + [b"", b"a" * i]
        at = table.lookup(chunks)
        assert table.gather(at).tolist() == [v for c in chunks for v in (len(c), *c)]
        assert table.lengths[at].tolist() == [len(c) + 1 for c in chunks] and len(table.starts) == len(table.index) <= 2302
