"""The pipeline: its stages against brute force over one small table, edge cases, contract."""

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ferrule.llm import langid, packing, secret_scan, toxicity
from ferrule.llm.common import crc_fold

from test_dedup import expected_groups
from test_text_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").where(crc_fold("doc_id", 3) != 1))
    clean = stages["toxicity"](spark, docs, SF)
    want = [r for r in rows if model.chances([toxicity.features(r["text"])])[0, 0] < 0.5]
    assert sorted(clean.collect()) == sorted(want) and 0 < len(want) < len(rows)

    known = stages["language_id"](spark, clean, SF)
    languages = langid.learn(clean.where(crc_fold("doc_id", 4) != 2))
    letters = set().union(*({c for c in r["text"].lower() if c.isalpha()} for r in clean.where(crc_fold("doc_id", 4) != 2).collect() if r["text"] and r["lang"]))
    want = [r for r in want if set(r["text"].lower()) & letters]
    assert sorted(known.collect()) == sorted(want)

    single = stages["simhash_dedup"](spark, known, SF)
    first = {c for *_, c in expected_groups([(r["doc_id"], r["text"]) for r in want])}
    want = [r for r in want if r["doc_id"] in first]
    assert sorted(single.collect()) == sorted(want)

    safe = stages["secret_scan"](spark, single, SF)
    assert safe.columns == docs.columns
    texts = {r["doc_id"]: secret_scan.redact(r["text"], secret_scan.scan(r["text"]), "<SECRET>") for r in want}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == texts
    assert not any(s[0] == "assign" for t in texts.values() for s in secret_scan.scan(t))

    pieces = stages["packing"](spark, safe, SF).collect()
    check_packing(pieces, list(texts.values()))
    ends = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    assert ends == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}

    assert sorted((p["doc_id"], p["start"], bytes(p["ids"])) for p in corpus_pipeline.run(spark, SF).collect() if p["start"] == 0 and p["length"] == p["doc_tokens"]) != []
    assert np.unique([p["doc_id"] for p in corpus_pipeline.run(spark, SF).collect()]).tolist() == sorted(texts)


def test_edges_pass_through_every_stage(spark, make_docs, edge_texts):
    docs = make_docs(edge_texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        empty = stage(spark, docs.limit(0), SF)
        if name != "packing":
            assert out.schema.names == docs.columns and empty.columns == docs.columns
            assert out.count() <= docs.count()
        assert empty.count() == 0
        out.collect()


def test_registered():
    queries = __spark_entry__.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op")) == list(range(1, 14))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "secret_scan", "packing"]
    assert packing.pack


def test_the_identified_language_reaches_the_sequences(spark, make_docs):
    """Null and clearly wrong labels become the identified language, ties, short texts and other labels stay, and no sequence mixes languages."""
    rng = np.random.default_rng(3)
    words = {lang: ["".join(rng.choice(list(alphabet), 5)) for _ in range(60)] for lang, alphabet in (("aa", "abcdefg"), ("bb", "hijklmn"))}

    def text(lang):
        return " ".join(rng.choice(words[lang], 150))

    truth = {i: "aa" if i % 3 else "bb" for i in range(90)}
    rows = [(i, text(lang), {7: None, 9: None, 11: "bb", 15: "aa", 20: "unlearned"}.get(i, lang), "s", 1) for i, lang in truth.items()]
    rows += [(100, "12 !", "aa", "s", 1), (101, "a h", "bb", "s", 1), (102, "a h", "aa", "s", 1), (103, " ".join(words["aa"][:3]), "bb", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    model = langid.learn(docs.where("lang in ('aa', 'bb') and doc_id not in (11, 15)").where("doc_id < 100"))
    known = langid.keep_identified(docs, model, lang="lang").collect()
    want = {**truth, 20: "unlearned", 101: "bb", 102: "aa", 103: "bb"}
    assert {r["doc_id"]: r["lang"] for r in known} == want and len(known) == len(rows) - 1
    assert sorted(langid.keep_identified(docs, model).collect(), key=str) == sorted((r for r in docs.collect() if r["doc_id"] != 100), key=str)

    staged = stages["language_id"](spark, docs, SF)
    assert {r["lang"] for r in staged.where("doc_id in (7, 9)").collect()} == {"aa", "bb"}
    pieces = stages["packing"](spark, staged, SF).collect()
    check_packing(pieces, [r[1] for r in rows if r[0] != 100])
    named = {r["doc_id"]: r["lang"] for r in staged.collect()}
    assert all(p["lang"] == named[p["doc_id"]] for p in pieces)
    of = {}
    for p in pieces:
        of.setdefault(p["sequence_id"], set()).add(p["lang"])
    assert all(len(langs) == 1 for langs in of.values()) and {x for langs in of.values() for x in langs} == set(named.values())
    for group_tokens in (1, 3000):
        again = packing.pack(docs.repartition(2), corpus_pipeline.TOKENIZER, by="lang", capacity=64, group_tokens=group_tokens).collect()
        check_packing(again, [r[1] for r in rows], capacity=64)
        own = {r[0]: r[2] for r in rows}
        assert len({(p["sequence_id"], own[p["doc_id"]]) for p in again}) == len({p["sequence_id"] for p in again})
