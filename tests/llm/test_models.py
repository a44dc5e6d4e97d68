"""Learned operators: held-out accuracy, brute force of the method's core, edge cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import fm_quality, langid, toxicity
from ferrule.llm.catalog import QUERIES, load_all
from ferrule.llm.common import crc_fold, hash_sample

load_all()
SF = "/root/testdata/sf0.01"


def held(doc_id, folds, n):
    return zlib.crc32(str(doc_id).encode()) % folds == n


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_fold_and_sample(spark):
    ids = spark.range(3000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'rare', 'common') AS c")
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in ids.limit(50).select("doc_id", crc_fold("doc_id", 3).alias("f")).collect())
    drawn, classes = hash_sample(ids, "c", "doc_id", 150)
    counts = {r["c"]: r["count"] for r in drawn.groupBy("c").count().collect()}
    assert classes == ["common", "rare"] and abs(counts["common"] - 150) < 50 and abs(counts["rare"] - 150) < 50
    assert hash_sample(ids.limit(0), "c", "doc_id", 10)[0].count() == 0


# -- language ----------------------------------------------------------------

def brute_phrases(text, labelled, piece=langid.PIECE):
    count = 0
    for lo in range(0, len(text), piece):
        part, at = text[lo:lo + piece], 0
        while at < len(part):
            n = 1
            while at + n <= len(part) and part[at:at + n] in labelled:
                n += 1
            at += max(1, n - 1)
            count += 1
    return count


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=40), st.lists(st.text(alphabet="abcz d", max_size=60), min_size=1, max_size=5))
def test_phrases_are_longest_matches(labelled, texts):
    labelled = langid.letters(labelled) or "a"
    model = langid.Model({"x": labelled, "y": "cab"})
    coded = [model.encode(t) for t in texts]
    got = model.phrases(coded)
    for t, counts in zip(texts, got, strict=True):
        assert counts.tolist() == [brute_phrases(langid.letters(t), labelled), brute_phrases(langid.letters(t), "cab")]


def test_pieces_start_anew():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 9))) for _ in range(900))
    model = langid.Model({"x": text[:700].strip()})
    assert model.phrases([model.encode(text)]).tolist() == [[brute_phrases(text, text[:700].strip())]]


def test_language_edges(make_docs, edge_texts, spark):
    model = langid.Model({"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune fuchs und der faule hund"})
    docs = make_docs(edge_texts)
    rows = langid.identify(docs, model).collect()
    by_text = dict(zip([r["text"] for r in docs.collect()], rows, strict=True))
    blank = [t for t in by_text if not any(c.isalpha() for c in t or "")]
    assert len(blank) == 4
    for t in blank:
        assert (by_text[t]["lang_pred"], by_text[t]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows) and len(rows) == len(edge_texts)
    assert model.predict(["der hund", "the dog", "中文"]) [0][0] == "de"
    assert model.predict(["中文"])[0][1] < 0.52      # no language knows a letter of it
    assert langid.Model({}).predict(["text", None]) == [("und", 0.0), ("und", 0.0)]
    assert langid.Model({"en": "abc"}).predict(["abc"]) == [("en", 1.0)]
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.where("text is null").count() == 0 and kept.limit(1).collect()[0]["score"] == "own score"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.learn(docs.limit(0)).langs == []
    assert langid.learn(make_docs(edge_texts, lang=None)).langs == []


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_cross_parsing_langid"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) >= 0.97


def test_every_language_is_learned_from_all_of_its_text(spark, make_docs):
    rng = random.Random(5)
    langs = {f"l{n:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(25)] for n in range(70)}
    rows = [(doc_id, " ".join(rng.choices(words, k=40)), lang) for doc_id, (lang, words) in enumerate((x for x in langs.items() for _ in range(3)))]
    rows = [r for r in rows if r[2] < "l68" or r[0] % 3]        # the last languages are the rarest
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(langs)
    assert [p[0] for p in model.predict([" ".join(words) for words in langs.values()])] == list(langs)

    def made(letters, n):
        return "".join("".join(rng.choices(letters, k=5)) + " " for _ in range(n // 6))

    rows = [(i, made("xyz", 15_000) + made(own, 15_000), lang) for i, (lang, own) in enumerate([("a", "abcde"), ("f", "fghij")])]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [p[0] for p in model.predict([made("abcde", 60), made("fghij", 60)])] == ["a", "f"]


def test_ties_are_kept_and_no_model_rejects_nothing(make_docs, edge_texts):
    model = langid.Model({"en": "this is a text", "de": "das ist a text"})
    docs = make_docs(["a", "text", "中文", "12 !", None, "", "this"])
    assert model.predict(["a"])[0][1] == 0.5
    assert sorted(r["text"] for r in langid.keep_identified(docs, model).collect()) == ["a", "text", "this"]
    assert langid.keep_identified(docs, model, least=0.505).where("text = 'a'").count() == 0
    none = langid.learn(make_docs(edge_texts, lang=None))
    assert langid.keep_identified(make_docs(edge_texts), none).count() == len(edge_texts)
    with pytest.raises(ValueError):
        langid.keep_identified(docs, none, allowed=["en"])


# -- quality -----------------------------------------------------------------

def test_pairwise_part_equals_the_double_sum():
    rng = np.random.default_rng(1)
    machine = fm_quality.Machine(np.zeros(len(fm_quality.STATS)), np.ones(len(fm_quality.STATS)), 4, 0)
    machine.w[:] = rng.normal(size=machine.w.shape)
    machine.w0 = 0.3
    described = [fm_quality.describe(t, None) for t in ("one two three two", "", "A b! 7 | c\nA b! 7 | c")]
    index, value, first = machine.rows(described)
    got, _ = machine.raw(index, value, first)
    for lo, hi, g in zip(first, [*first[1:], len(index)], got, strict=True):
        i, x = index[lo:hi], value[lo:hi]
        pairs = sum(machine.v[i[a]] @ machine.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert g == pytest.approx(0.3 + machine.w[i] @ x + pairs)


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    rows = QUERIES["op2_fm_quality"](spark, SF).collect()
    assert len(rows) == table(spark, "documents").count() and all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_edges(make_docs, edge_texts, spark):
    docs = make_docs(edge_texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, None), (0, 1, None), (6, 0, 1), (7, 1, 0), (99, 0, 0), (None, 1, 1), (3, None, None), (4, 5, 5)], "doc_id long, quality int, toxic int")
    blank = fm_quality.score(docs, fm_quality.learn(docs, none)).collect()
    assert [r["score"] for r in blank] == [0.5] * len(edge_texts)
    rows = fm_quality.score(docs, fm_quality.learn(docs, odd)).collect()
    assert len(rows) == len(edge_texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (8, 9)}) == 1
    bare = docs.select("doc_id", "text")
    assert fm_quality.score(bare, fm_quality.learn(bare, odd)).count() == len(edge_texts)
    assert fm_quality.score(docs.limit(0), fm_quality.learn(docs, none)).count() == 0
    assert fm_quality.learn(docs.limit(0), odd).w.any() == np.False_


# -- toxicity ----------------------------------------------------------------

def test_toxicity_orders_grades():
    """A planted scale: the more bad words, the higher the grade."""
    rng = random.Random(4)
    texts, grades = [], []
    for _ in range(600):
        g = rng.randrange(4)
        words = [f"plain{rng.randrange(50)}" for _ in range(30)] + rng.sample(["vile", "nasty", "awful", "foul", "grim", "rotten"], 2 * g)
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    found = [toxicity.features(t) for t in texts]
    model = toxicity.Severity(toxicity.features("vile nasty awful foul grim rotten"))
    model.fit(found, np.array(grades), 400, 0.05, 1e-4)
    p = model.chances(found)
    assert (np.diff(model.cuts) > 0).all() and (np.diff(p, axis=1) <= 0).all()
    assert np.mean(np.rint(p.sum(axis=1)) == grades) >= 0.99
    assert np.abs(p.sum(axis=1) - grades).mean() < 0.2


def test_toxicity_features():
    assert toxicity.features(None).size == toxicity.features("123 !?").size == 0
    assert set(toxicity.features("Trash")) == {zlib.crc32(x) for x in (b"trash", b"tras-")}
    assert (toxicity.features("a trash, TRASH") == toxicity.features("trash a")).all()


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, "labels").collect()}
    rows = QUERIES["op6_ordinal_toxicity"](spark, SF).collect()
    assert len(rows) == table(spark, "documents").count()
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in out]) >= 0.9
    assert all(0 <= r["severity"] <= toxicity.GRADES and r["grade"] == round(r["severity"]) for r in rows)


def test_toxicity_edges(make_docs, edge_texts, spark):
    docs = make_docs(edge_texts)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert not any(r["toxic"] for r in toxicity.grade(docs, model).collect())
    odd = spark.createDataFrame([(6, 1), (6, 1), (7, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.grade(docs, toxicity.learn(docs, odd)).count() == len(edge_texts)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(edge_texts)
    assert toxicity.reject_toxic(docs.limit(0), model).count() == 0 and toxicity.grade(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs.limit(0), odd).kept.size == 0
