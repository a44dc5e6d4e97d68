"""Source divergence against a direct computation over every kept term and pair of sources."""

import re
from collections import Counter

import pytest

from ferrule.llm import divergence

ROWS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {x for _, x, _ in rows}:
        docs = [(s, TERM.findall(lower(t))) for t, x, s in rows if x == lang]
        held = Counter(w for _, words in docs for w in set(words))
        kept = [w for w, n in held.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in docs}
        for s, words in docs:
            counts[s].update(w for w in words if held[w] >= min_docs)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        p = {s: {w: share(c, w) for w in kept} for s, c in counts.items()}
        q = {w: share(whole, w) for w in kept}
        far = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {"pair": [(o, sum(far(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s],
                     "term": [(w, far(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


SAMPLE = [(i, t, lang, f"s{i % 5}") for i, (t, lang) in enumerate([
    ("The cat, the CAT and the dog.", "en"), ("a dog; a cat; ünï Ünï çödé", "en"), ("the the the dog it's", "en"), ("cat dog bird fish ünï", "en"),
    ("bird bird bird", "en"), ("le chat \U0001f600\U0001f600 noir", "fr"), ("le chien noir", "fr"), ("le chat le chat", "fr"), ("noir x1y2 x x y", "fr"),
    ("once only", "de"), ("", "de"), (None, None), ("123 456 .,;", ""), ("the cat", None)] * 3)]
SAMPLE += [(1000, None, "en", None), (None, "the cat the end", "en", "s0"), (1001, "\x00the\x7fcat\x1c", "en", "quiet"), (1002, "nothing here", "xx", "alone")]


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_audit_against_brute_force(spark, bits):
    docs = spark.createDataFrame(SAMPLE, ROWS).repartition(3)
    got = divergence.audit(docs, digest_bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(SAMPLE)


def test_only_the_top_terms_with_ties(spark):
    rows = [(i, " ".join(f"w{'abcdefghij'[k]}" for k in range(i % 10 + 1)), "en", f"s{i % 3}") for i in range(60)]
    got = divergence.audit(spark.createDataFrame(rows, ROWS), top=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, top=2)


def test_many_sources_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 50)
    monkeypatch.setattr(divergence, "HELD", 200)
    rows = [(i, f"common word {'ab' * (i % 7)} {'c' * (i % 11)}", "en", f"s{i % 23}") for i in range(300)]
    got = divergence.audit(spark.createDataFrame(rows, ROWS).repartition(4))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edges(make_docs, edge_texts):
    docs = make_docs([t for t in edge_texts if not isinstance(t, str) or len(t) < 10**5]).withColumnRenamed("k", "value").withColumnRenamed("h", "rank")
    got = divergence.audit(docs, min_docs=1)
    assert sorted(map(tuple, got.collect())) == brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()], min_docs=1)
    assert divergence.audit(docs.limit(0)).count() == 0
    long = make_docs(edge_texts)
    assert divergence.audit(long, min_docs=1).where("part = 'term'").count() <= 200
