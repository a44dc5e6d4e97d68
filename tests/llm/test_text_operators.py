"""Quality rules, sharding, packing, BPE and secrets against brute force and on edge cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrule.llm import bpe, packing, quality_rules, secret_scan, sharding
from ferrule.llm.catalog import QUERIES, load_all

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
load_all()


def collected(df):
    return sorted(df.collect(), key=lambda r: str(tuple(r)))


# -- BPE ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_tools():
    with open(BYTE) as f:
        return bpe._tools(f.read()), Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab 's1\n é中", max_size=40), st.just("<|endoftext|>")), max_size=4).map("".join))
def test_bpe_equals_the_library(byte_tools, text):
    (vocabulary, cache), library = byte_tools
    packed = bpe.encode_texts([text], vocabulary, cache)[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert bpe.decode_ids(packed, vocabulary) == library.decode(want, skip_special_tokens=False) == text


def test_bpe_long_words_and_invalid_ids(byte_tools):
    (vocabulary, cache), library = byte_tools
    for text in ("a" * 5000, "ab" * 1500 + "z", "é" * 400, " " * 3000):
        assert np.frombuffer(bpe.encode_texts([text], vocabulary, cache)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.merge_long(b"hello") == vocabulary.merge_short([b"hello"])[0]
    assert bpe.decode_ids(np.array([10**6], "<u4").tobytes(), vocabulary) == ""
    half = bpe.encode_texts(["é"], vocabulary, cache)[0][:4]
    assert bpe.decode_ids(half, vocabulary) in ("é", "�")


def test_bpe_cache_is_bounded(byte_tools):
    (vocabulary, _), library = byte_tools
    small = bpe.WordIds(vocabulary, most=5)
    text = "one two three four five six seven eight nine ten"
    for _ in range(3):
        assert np.frombuffer(bpe.encode_texts([text], vocabulary, small)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(small) <= 15


def test_bpe_operator_edges(make_docs, edge_texts, byte_tools):
    docs, library = make_docs(edge_texts), byte_tools[1]
    rows = collected(bpe.round_trip(docs, BYTE))
    pairs = collected(docs.select("doc_id", "text"))
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in rows) == sorted(
        (str(p["doc_id"]), np.array(library.encode(p["text"] or "", add_special_tokens=False).ids, "<u4").tobytes(), p["text"] or "") for p in pairs)
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((p["doc_id"], p["text"] or "")) for p in pairs)
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


def test_bpe_query_digests(spark):
    library = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op10_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# -- packing -----------------------------------------------------------------

def check_packing(pieces, texts, capacity=2048):
    """Every id in one piece, offsets without gaps, sequences full or of a power of two."""
    library = Tokenizer.from_file(WORD)
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts)
    docs, sequences = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) // 4 > 0
        docs.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append((p["start"], bytes(p["ids"])))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
    if len(docs) == len(texts):
        assert sorted(b"".join(x for _, x in sorted(parts)) for parts in docs.values()) == want
    assert sum(p["length"] for p in pieces) == sum(len(w) for w in want) // 4


def test_packing_edges(make_docs, edge_texts):
    docs = make_docs(edge_texts)
    check_packing(packing.pack(docs, WORD).collect(), edge_texts_of(docs))
    assert packing.pack(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, capacity=1000)


def edge_texts_of(docs):
    return [r["text"] for r in docs.select("text").collect()]


def test_packing_groups_and_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = edge_texts_of(docs)
    check_packing(packing.pack(docs, WORD).collect(), texts)
    check_packing(packing.pack(docs.repartition(3), WORD, group_tokens=20_000).collect(), texts)
    rows = QUERIES["op7_cost_balanced_packing"](spark, "/root/testdata/sf0.001").collect()
    assert {r["ids_crc32"] for r in rows} == {zlib.crc32(bytes(p["ids"])) for p in packing.pack(docs, WORD).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=40))
def test_balance_fills_sequences_and_balances_cost(lengths):
    lengths = np.array(lengths)
    sequences = int(lengths.sum()) // 64
    placed, left = packing.balance(lengths, sequences, 64, 1.0, 1 / 64)
    used = np.zeros(sequences, int)
    for _, _, n, at, offset in placed:
        assert used[at] == offset
        used[at] += n
    assert (used == 64).all()
    assert sum(n for *_, n in left) == lengths.sum() - 64 * sequences
    own = {i: 0 for i in range(len(lengths))}
    for i, start, n in sorted([(i, s, n) for i, s, n, _, _ in placed] + left):
        assert own[i] == start
        own[i] += n
    assert list(own.values()) == lengths.tolist()


def test_packing_prefers_the_lowest_cost():
    placed, left = packing.balance(np.array([8, 8, 4, 4, 4, 4]), 2, 16, 1.0, 1.0)
    assert not left
    assert sorted((at, n) for _, _, n, at, _ in placed) == [(0, 4), (0, 4), (0, 8), (1, 4), (1, 4), (1, 8)]


def test_lower_words_equal_the_library():
    with open(WORD) as f:
        spec = f.read()
    words, library = packing.LowerWords(spec), Tokenizer.from_str(spec)
    for text in ("It's HE'LL ÀÉ ß² x1\x85y\xa0z", "<|endoftext|>a <|startoftext|>", "Σας İ é 中", "", None, "don't\x1cstop"):
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


# -- sharding ----------------------------------------------------------------

def test_sharding_edges(make_docs, edge_texts):
    docs = make_docs(edge_texts)
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == len(edge_texts)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in edge_texts_of(docs))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, slot_buckets=100)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_sharding_follows_weights_and_moves_little(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    rows = sharding.assign_shards(ids, weights=[1.0, 2.0, 1.0], grown_weights=[1.0, 2.0, 1.0, 4.0]).collect()
    share = np.bincount([r["shard"] for r in rows]) / len(rows)
    assert np.abs(share - [0.25, 0.5, 0.25]).max() < 0.02
    assert abs(sum(r["grown_shard"] == 3 for r in rows) / len(rows) - 0.5) < 0.02
    again = sharding.assign_shards(ids.repartition(7), weights=[1.0, 2.0, 1.0]).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


# -- quality rules -----------------------------------------------------------

def base_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts(spark, make_docs, edge_texts):
    repeated = ["a b c a b c d", "x x x x", "l1 w\nl1 w\n\n \nl1 w ", "a b c d a b c", "# * $ a|b <c>"]
    docs = make_docs(edge_texts + repeated).unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    rows = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    got = sorted(str(tuple(r)) for r in rows)
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = base_counts(r["text"])
        want.append(str((r["doc_id"], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])))
    assert got == sorted(want)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_line_rules(make_docs):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    texts = [prose, f"{prose}\nHome\nAll rights reserved\nHome | News | Sport | More", "\n".join(["a | b | c | d"] * 60),
             f"{prose}\n" + " ".join(f"other{i}***" for i in range(60)), "\n".join([prose] * 2)]
    rows = sorted(quality_rules.quality_rules(make_docs(texts)).collect(), key=lambda r: r["doc_id"])
    assert [r["kept"] for r in rows] == [True, True, False, False, False]
    assert rows[1]["clean_text"] == prose and (rows[1]["n_navigation"], rows[1]["n_boilerplate"]) == (2, 1)
    assert rows[3]["n_punctuation"] == 1 and not rows[3]["base_failed"]
    assert rows[4]["n_dup_lines"] == 1 and rows[4]["base_failed"]


def test_quality_line_rules_of_four_languages(make_docs):
    """Menus and notices go in each language; prose that holds their words among others stays."""
    menus = {"en": ["Back to top", "Page 2 of 9"], "de": ["Zurück", "ÜBER UNS", "Seite 2 von 9"], "es": ["Leer más", "MENÚ", "Página 2 de 9"],
             "fr": ["Précédent", "À propos", "S’inscrire", "Page 2 sur 9"]}
    notices = {"en": ["We use cookies."], "de": ["Alle Rechte vorbehalten.", "Unsere Datenschutzerklärung"], "es": ["Todos los derechos reservados", "Política de privacidad"],
               "fr": ["Tous droits réservés.", "Les conditions d’utilisation"]}
    prose = {"en": "They went back to the top of the hill.", "de": "Sie gingen weiter und dann zurück über den Fluss.",
             "es": "El inicio del camino queda más arriba.", "fr": "La page suivante parle de cet accueil."}
    lines = {lang: "\n".join([" ".join(f"{lang}{i}" for i in range(80)) + ".", prose[lang], *menus[lang], *notices[lang]]) for lang in menus}
    rows = sorted(quality_rules.quality_rules(make_docs(list(lines.values()))).collect(), key=lambda r: r["doc_id"])
    for lang, row in zip(lines, rows, strict=True):
        assert row["kept"] and (row["n_navigation"], row["n_boilerplate"]) == (len(menus[lang]), len(notices[lang])), lang
        assert row["clean_text"].split("\n")[1:] == [prose[lang]]


def test_every_notice_holds_a_part_that_is_looked_for(make_docs):
    """Every choice of the notices' pattern, spelled out, in capitals: found in texts that are first searched for its part."""
    choices = re.split(r"\|(?![^()]*\)(?!$))", quality_rules.BOILERPLATE.removeprefix("(?i)(").removesuffix(")"))
    spelled = []
    for choice in choices:
        tokens = re.findall(r"\\[()]|\((?:[^()]*)\)\??|\[[^]]*\]|.", choice)
        spelled += ["".join(x) for x in itertools.product(*(
            [t[1]] if t[0] == "\\" else [*re.sub(r"\[(.)[^]]*\]", r"\1", t).strip("()?").split("|"), *([""] if t[-1] == "?" else [])] if t[0] == "(" else t[1:-1] if t[0] == "[" else ["'" if t == "." else t]
            for t in tokens))]
    assert len(choices) == 34 and all(re.search(quality_rules.BOILERPLATE, x) for x in spelled)
    assert all(any(part in x.lower() for part in quality_rules.NOTICE_PARTS) for x in spelled)
    texts = [f"first line.\n{re.sub('[a-z]+', lambda m: m[0].upper(), x)}" for x in spelled]
    assert [(r["n_boilerplate"], r["clean_text"]) for r in quality_rules.quality_rules(make_docs(texts)).collect()] == [(1, "first line.")] * len(texts)


def test_quality_plan_is_native(make_docs):
    plan = quality_rules.quality_rules(make_docs(["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


# -- secrets -----------------------------------------------------------------

def brute_base(text):
    out = []
    for kind, pattern, ok in (
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "API_key", "apikey", "secret", "token", "=", ":", " ", "'", '"', "AKIA", "AKIA1234567890ABCD",
                                 "deadbeef", "0123456789abcdef", "Abc/def+12.x_-=", "\n", "é", "x", "name", "+"]), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert [s[:3] for s in secret_scan.scan(text) if s[0] != "lexed"] == brute_base(text)
    assert len(secret_scan.redact(text, secret_scan.scan(text), "")) <= len(text)


def test_secret_lexing():
    def values(text):
        return [text[a:b] for a, b in secret_scan.lexed(text)]

    assert values('default_value = "hunter2Zx9!"\ndb.password = default_value') == ["hunter2Zx9!"]
    assert values('part = "abcDEF12"\nclientSecret: part + "ghiJKL34"') == ["abcDEF12", "ghiJKL34"]
    assert values('Authorization: Bearer eyJhbGciOi.J9xK2') == ["eyJhbGciOi.J9xK2"]
    assert values('password = "changeme"\ntoken: "${TOKEN}"\nsecret = none') == []
    assert values('colour = "x8Fk2mQ9zL"\nurl = https://a.b/c') == []
    assert values("if token == other: pass") == []
    assert secret_scan.redact("pwd = 'x8Fk2mQ9zL'; n = 1", secret_scan.scan("pwd = 'x8Fk2mQ9zL'; n = 1"), "<S>") == "pwd = '<S>'; n = 1"


def test_secret_constants_and_names_of_any_length():
    def values(text):
        return [text[a:b] for a, b in secret_scan.lexed(text)]

    parts = [f"Part{i:02}xQ9z" for i in range(40)]
    listed = " + ".join(f'"{p}"' for p in parts)
    assert values(f"k = {listed}\napi_key = k") == parts
    assert values("\n".join(f'k{i} = "{p}"' for i, p in enumerate(parts)) + "\nall = " + " + ".join(f"k{i}" for i in range(40)) + "\napi_key = all") == parts
    assert values('k = "Part01xQ9z"\n' + "k = k + k\n" * 200 + "password = k") == ["Part01xQ9z"]
    chain = 'k0 = "Part00xQ9z"\n' + "".join(f'k{i} = k{i - 1} + "Part{i}xQ9z"\npassword = k{i}\n' for i in range(1, 3000))
    assert len(values(chain)) == 3000
    long = "a." * 100 + "b"
    assert values(f'{long} = "x8Fk2mQ9zL"\npassword = {long}') == ["x8Fk2mQ9zL"]
    assert values(f'password.{long} = "x8Fk2mQ9zL"') == ["x8Fk2mQ9zL"]
    assert values("password" + " " * 500 + '= "x8Fk2mQ9zL"') == ["x8Fk2mQ9zL"]


def test_secret_typed_and_subscripted_names():
    def values(text):
        return [text[a:b] for a, b in secret_scan.lexed(text)]

    for left in ("password: str", "let apiKey: string", "const TOKEN: &str", "static SECRET: &'static str", "pwd: Optional[str]", "password: std::string",
                 "token: str | None", "token: Dict[str, List[Optional[str]]]", "pwd: &[u8]", 'secret: "SecretText"', 'config["db_password"]', "os.environ['API_KEY']", 'os.environ["A=B:password"]',
                 'cfg [ "x" ] [ "pwd" ]', "char password[32]", "char password[]", 'a["api"]["key"]', "cfg[DB_PASSWORD]", "command: password"):
        assert values(f'{left} = "x8Fk2mQ9zL"')[-1:] == ["x8Fk2mQ9zL"], left
    assert values('k: str = "x8Fk2mQ9zL"\npassword = k') == ["x8Fk2mQ9zL"]
    assert values('c["k"] = "x8Fk2mQ9zL"\npassword = c["k"]') == ["x8Fk2mQ9zL"]
    assert values('c["k"] = "x8Fk2mQ9zL"\nd["j"] = "y8Fk2mQ9zL"\npassword = d["j"] + c["k"]') == ["x8Fk2mQ9zL", "y8Fk2mQ9zL"]
    assert values("pwd=/x8Fk2mQ9zL") == ["/x8Fk2mQ9zL"]
    assert values("secret://x8Fk2mQ9zL") == []
    assert values('] = "x8Fk2mQ9zL"\n["password"] = "x8Fk2mQ9zL"\npassword\n] = "x8Fk2mQ9zL"') == []
    assert values('def f(password: str, name="Alice7Cooper")') == values('password: x; name = "Alice7Cooper"') == values('password: see name = "Alice7Cooper"') == []
    assert values('colour: str = "x8Fk2mQ9zL"\ncfg["colour"] = "x8Fk2mQ9zL"') == []
    assert values('names: list[str] = "Alice7Cooper"\npassword: str') == []


def test_secret_operators_edges(make_docs, edge_texts, spark):
    docs = make_docs(edge_texts)
    rows = secret_scan.find_secrets(docs).collect()
    assert len(rows) == len(edge_texts)
    assert sum(len(r["spans"]) for r in rows) == 2      # the token line: assign and hex
    clean = secret_scan.redact_secrets(docs, length="n_chars")
    assert clean.schema == docs.schema
    by_text = {r["text"]: r for r in clean.collect()}
    assert by_text['token = "<SECRET>"']["n_chars"] == 18 and by_text['token = "<SECRET>"']["spans"] == "own spans"
    assert clean.where("text is null").count() == 2 and clean.count() == len(edge_texts)
    assert secret_scan.redact_secrets(docs.limit(0)).count() == 0
    got = {r["doc_id"]: r for r in QUERIES["op8_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        base = brute_base(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[r["doc_id"]]["n_hex"] == sum(k == "hex" for k, _, _ in base)


@pytest.mark.parametrize("unit,end", [("a=", ""), ("a:", ""), ("AB:", ""), ("token=", "Ab3$xY9z"), ("a=b+", ""), ("token=Qb7x9Zk2+", ""), ("a[", "=1"), ("a[1]", "=x"),
                                      ("a=(", ""), ("t=f(a,", ""), ('a="a=', ""), ("token=example=", ""), ("a=.", ""), ("token='", ""), (" ", "$ = 1"), ('a="""', "")])
def test_secret_scan_is_linear(unit, end):
    import time

    took = []
    for size in (40_000, 400_000):
        text = "x:" + unit * (size // len(unit)) + end
        begin = time.process_time()
        secret_scan.scan(text)
        took.append(time.process_time() - begin)
    assert took[1] < 40 * max(took[0], 0.02)        # 10 times the text; a quadratic reader takes 100 times


LITERAL = "Xk39fk3kd93"


@pytest.mark.parametrize("text", ['password = f"{}"', "password = b'{}'", 'password = R"{}"', 'password = """{}"""', "password = '''{}'''", 'password = (\n    "{}"\n)', 'password = \\\n  "{}"',
                                  'password = x or "{}"', 'password = a.b || "{}"', 'password = os.getenv("DB_PASSWORD_NAME", "{}")', 'password = decode("{}")', "db_pass: {}", 'k = "{}"\npassword = k'])
def test_secret_literal_forms(text):
    text = text.replace("{}", LITERAL)
    assert [text[a:b] for a, b in secret_scan.lexed(text)] == [LITERAL]


def test_calls_and_names_are_no_secrets():
    for text in ("token = get_token()", "password = os.getenv", 'password = os.environ.get("MY_PASSWORD_NAME")', "password = settings.db.password_value(1)"):
        assert [text[a:b] for a, b in secret_scan.lexed(text) if "(" in text] == []


@given(st.text(st.sampled_from("abXY19=:/_-ÄßeE"), min_size=257, max_size=400))
def test_long_ends_weigh_as_literals_do(text):
    reader = secret_scan.Reader(text)
    for at in [0, *(m.end() for m in secret_scan.OPERATOR.finditer(text))]:
        assert reader.weight(at, len(text)) == pytest.approx(secret_scan.literal_weight(text[at:]))
