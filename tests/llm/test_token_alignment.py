"""Token alignment against the libraries on whole texts and a plain search for shared ends."""

import bisect
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrule.llm import bpe, token_alignment
from ferrule.llm.catalog import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
STAND_IN = bpe.byte_alphabet()


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A_FILE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def encoded(text, first, second):
    one = first.encode(" " + text, add_special_tokens=False)
    b = second.encode(text)
    pieces = [second.id_to_piece(i) for i in b]
    two = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    return one.ids, [bytes(STAND_IN[c] for c in t) for t in one.tokens], b, two


def brute(rows, libraries):
    """Per row: counts, digest and links as a Counter of id pairs."""
    out = []
    for text in rows:
        if not text:
            out.append((0, 0, 0, "", Counter()))
            continue
        a, one, b, two = encoded(text, *libraries)
        if not b"".join(one) == b"".join(two) == (" " + text).encode():
            out.append((0, 0, 0, "", Counter()))
            continue
        ends = []
        for tokens in (one, two):
            at = 0
            ends.append([at := at + len(t) for t in tokens])
        groups = [([], []) for _ in range(len(set(ends[0]) & set(ends[1])) + 1)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        for side, (ids, at) in enumerate(zip((a, b), ends, strict=True)):
            for i, e in zip(ids, at, strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        assert groups.pop() == ([], [])
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), hashlib.sha256(told.encode()).hexdigest(), Counter((i, j) for x, y in groups for i in x for j in y)))
    held = Counter(p for *_, links in out for p in links)
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(*x[:3], sum(x[4].values()), sum(n for p, n in x[4].items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in x[4].items()), x[3]) for x in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["a ", " ", "  ", " a  b   c ", "a\n b\t c\r\n  d", "tab\t tab", "x\x85 y\xa0 z　 w  v", "x▁y", "<s> </s> <unk> <0x41> <|endoftext|>", "ﬁ ① ½ é é",
       "\x00 \x01\x1c \x1d a", "\U0001f600 \U0001f600\U0001f600", "中文字 漢字 かな", "a" * 5000, "ab" * 3000 + " " + "9" * 2000, "it's I'll we've 's", "   \n\n   x", "", None,
       "é ü ö", "tail \n ", "tail　 ", "1 22 333 4444 55555", "同 same same 同", "a b", "a b"]


@pytest.mark.parametrize("known", [token_alignment.KNOWN, 40, 0])
def test_alignment_against_the_libraries(spark, libraries, known):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, A_FILE, B_FILE, known=known).collect()}
    want = brute(texts, libraries)
    assert [(i, got[i]) for i in sorted(got)] == list(enumerate(want))


def test_query(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], libraries), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.Z9é中 \t\n\xa0\x85 　\x1c▁"), max_size=12), min_size=1, max_size=6))
def test_parts_give_what_whole_texts_give(libraries, texts):
    tools = HELD.setdefault("tools", token_alignment.Pair(open(A_FILE).read(), open(B_FILE, "rb").read()) if "tools" not in HELD else None)
    import pyarrow as pa

    rows = next(token_alignment._align_slice(pa.array(range(len(texts))), [t.encode() for t in texts], tools, 0))
    want = brute(texts, libraries)
    assert [tuple(rows[c][i].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for i in range(len(texts))] == [(*w[:4], w[6]) for w in want]


HELD = {}


def test_different_parts_are_aligned_in_one_call(libraries):
    """Odd parts among plain ones: bytes that differ, equal ends, a group of many tokens; each as it is alone."""
    import numpy as np

    tools = token_alignment.Pair(open(A_FILE).read(), open(B_FILE, "rb").read())
    parts = [" the", " ﬁ", " unthinkably", " " + "ab" * 300 + "9" * 200, " ½", " 中文字", " the house"]
    first, second = libraries
    a = [first.encode(t, add_special_tokens=False).ids for t in parts]
    b = [second.encode(t[1:]) for t in parts]
    a[5], b[5] = [a[5][0]] * 12 + a[5], b[5]        # more bytes than the part
    flat = lambda x: (np.array([i for y in x for i in y], dtype=np.int64), np.array([len(y) for y in x]))
    numbers, told, sizes, keys, times = tools.align([t.encode() for t in parts], *flat(a), *flat(b))
    want = brute([t[1:] for t in parts[:5]] + [None] + ["the house"], libraries)
    assert [tuple(n) for n in numbers.tolist()] == [w[:4] for w in want] and len(told) == len(parts)
    assert [hashlib.sha256(t).hexdigest() if t else "" for t in told] == [w[6] for w in want]
    at = np.cumsum(sizes) - sizes
    assert [int(times[lo:lo + n].sum()) for lo, n in zip(at, sizes, strict=True)] == [w[3] for w in want]
    alone = [tools.align([t.encode()], *flat([x]), *flat([y])) for t, x, y in zip(parts, a, b, strict=True)]
    links = lambda k, t: sum((Counter({int(i): int(j)}) for i, j in zip(k, t, strict=True)), Counter())
    assert [links(keys[lo:lo + n], times[lo:lo + n]) for lo, n in zip(at, sizes, strict=True)] == [links(*x[3:]) for x in alone]


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_groups_against_set_intersection(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    cuts = sorted(set(a) & set(b))
    got = token_alignment.groups_of(a, b)
    assert [a[ah - 1] for _, ah, _, _ in got] == cuts == [b[bh - 1] for _, _, _, bh in got]
    assert [g[0] for g in got] == [0, *(g[1] for g in got[:-1])] and [g[2] for g in got] == [0, *(g[3] for g in got[:-1])]


def test_long_intervals_stay_fast():
    import time

    n = 200_000
    begin = time.time()
    assert len(token_alignment.groups_of(list(range(1, n + 1)), list(range(1, n + 1)))) == n
    assert len(token_alignment.groups_of([*range(1, 2 * n, 2), 2 * n], [*range(2, 2 * n, 2), 2 * n])) == 1
    sparse = [*range(1, 500), *range(1000, n, 2), *range(n, n + 500)]
    assert len(token_alignment.groups_of(sparse, [*range(1, 500), *range(1001, n, 2), *range(n, n + 500)])) == 999
    assert time.time() - begin < 20


def test_edges(make_docs, edge_texts, libraries):
    docs = make_docs(edge_texts)
    rows = docs.select("doc_id", "text").collect()
    got = token_alignment.align(docs, A_FILE, B_FILE).collect()
    want = brute([r["text"] for r in rows], libraries)
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(r["doc_id"]), *w) for r, w in zip(rows, want, strict=True))
    assert token_alignment.align(docs.limit(0), A_FILE, B_FILE).count() == 0


def test_best_links(make_docs):
    docs = make_docs(["the cat", "the dog", "the the"])
    rows = token_alignment.best_links(docs, A_FILE, B_FILE).collect()
    assert max(r["docs"] for r in rows) == 3 and len(rows) == len({r["a_id"] for r in rows})
