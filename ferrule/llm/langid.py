"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text accepts exactly the substrings of that
text. A document is cross-parsed against each automaton: every phrase is the longest match
from where the last one ended. A phrase costs log2 of the labelled text's length (a pointer
into it), so ``phrases * log2(length) / characters`` estimates the cross entropy in bits a
character, and the language with the fewest normalised phrases wins.

Greedy longest matches need the forward transitions only, so an automaton becomes a table
``state, letter -> next state, phrases ended``, and numpy walks all pieces of a batch through
all tables at once, one letter a step. A parse starts anew at every ``PIECE`` letters, alike
for every language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import hash_sample, text_slices

PIECE = 1024
#: Pieces that a long labelled document gives.
SPREAD = 4
UNKNOWN = "und"


def letters(text: str) -> str:
    """Lower-cased letters; every run of other characters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Model:
    """Languages with their labelled text, as one table for all automata.

    A state is a row of cells, one for each letter of its own language's text, so a language's
    size doesn't depend on the others. ``table[state + column]`` is ``next_state * 4 + phrases
    ended (0 to 2)``; the first state of language l is ``roots[l]``, and ``columns[code, l]`` is
    the column of a code there. Code 0 is the space, ``other`` any letter that no labelled text
    holds, and the last code pads pieces and changes nothing. A language's last two columns are
    letters that its text doesn't hold, and the pad.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(lang for lang, text in texts.items() if text)
        alphabet = sorted(set("".join(texts[lang] for lang in self.langs)) - {" "})
        code = {c: i for i, c in enumerate([" ", *alphabet])}
        self.other, self.pad = len(code), len(code) + 1
        self.columns = np.zeros((len(code) + 2, len(self.langs)), dtype=np.int64)
        tables, roots, first = [], [], 0
        for at, lang in enumerate(self.langs):
            moves = suffix_automaton(texts[lang])
            root = moves[0]
            own = {c: i for i, c in enumerate([" ", *sorted(set(texts[lang]) - {" "})])}
            width = len(own) + 2
            self.columns[:, at] = [*(own.get(c, width - 2) for c in code), width - 2, width - 1]
            to = np.full((len(moves), width), -1, dtype=np.int64)
            for state, out in enumerate(moves):
                for c, target in out.items():
                    to[state, own[c]] = target
            fresh = np.array([root.get(c, 0) for c in own] + [0, 0])        # where a new phrase goes on from the start
            ended = np.where(np.array([c in root for c in own] + [False, False]), 1, 2)
            cell = np.where(to >= 0, (to * width + first) * 4, (fresh * width + first) * 4 + ended)
            cell[0] = np.where(to[0] >= 0, cell[0], first * 4 + 1)          # at the start no phrase is open
            cell[:, -1] = (np.arange(len(moves)) * width + first) * 4
            tables.append(cell.ravel().astype(np.int32 if (first + cell.size) * 4 < 2**31 else np.int64))
            roots.append(first)
            first += cell.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, dtype=np.int64)
        self.bits = np.array([max(1.0, math.log2(len(texts[lang]))) for lang in self.langs])
        self.codes = np.zeros(0x110000, dtype=np.uint8 if self.pad < 256 else np.uint16 if self.pad < 65536 else np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                self.codes[point] = code.get(c.lower(), self.other)

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text; runs of non-letters are one space, none at the ends."""
        codes = self.codes[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        keep = codes != 0
        if len(keep):
            keep[1:] |= codes[:-1] != 0
        codes = codes[keep]
        return codes[:-1] if len(codes) and codes[-1] == 0 else codes

    def holds(self, text: str) -> bool:
        """Whether a labelled text holds a letter of ``text``."""
        codes = self.encode(text)
        return bool(((codes != 0) & (codes != self.other)).any())

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text under each language."""
        pieces, owner = [], []
        for i, codes in enumerate(coded):
            for lo in range(0, len(codes), PIECE):
                pieces.append(codes[lo:lo + PIECE])
                owner.append(i)
        out = np.zeros((len(coded), len(self.langs)), dtype=np.int64)
        order = sorted(range(len(pieces)), key=lambda p: -len(pieces[p]))
        for at in range(0, len(order), 4096):
            part = order[at:at + 4096]
            sizes = np.array([len(pieces[p]) for p in part])
            codes = np.full((len(part), int(sizes[0])), self.pad, dtype=self.codes.dtype)
            for row, p in enumerate(part):
                codes[row, :sizes[row]] = pieces[p]
            codes = np.ascontiguousarray(codes.T)
            state = np.repeat(self.roots[None, :], len(part), axis=0)
            count = np.zeros(state.shape, dtype=np.int64)
            for step in range(len(codes)):
                live = int(np.searchsorted(-sizes, -step, side="left"))     # pieces longer than step
                cell = self.table[state[:live] + self.columns[codes[step, :live]]]
                count[:live] += cell & 3
                state[:live] = cell >> 2
            count += state != self.roots
            np.add.at(out, np.array([owner[p] for p in part]), count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of whole texts; ties go to the language that sorts first.

        The score is second / (best + second) of the estimated entropies: 0.5 is undecided. A null
        text, a text without a letter, or a model without languages gives ``und`` and 0.
        """
        coded = [self.encode(t) if t and self.langs else np.zeros(0, np.uint8) for t in texts]
        out = []
        entropy = self.phrases(coded) * self.bits
        for codes, h in zip(coded, entropy, strict=True):
            if not len(codes):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(h.argmin())
            rest = np.delete(h, best)
            out.append((self.langs[best], float(rest.min() / (h[best] + rest.min())) if len(rest) else 1.0))
        return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          lang_chars: int = 40_000, per_class: int = 80) -> Model:
    """Automata of about ``per_class`` documents of each language in ``docs`` (pass the rows to learn from).

    Every labelled language has a model. Its labelled text is bounded by ``lang_chars`` letters, alike
    for any number of languages, of which one document gives at most a sixteenth: the whole of a short
    text, else ``SPREAD`` pieces, each at a hashed place within its own equal part of the text. Rows
    with a null or empty text or language aren't used.
    """
    rows, _ = hash_sample(docs.where(F.length(text) > 0).select(key, text, lang), lang, key, per_class)
    share = max(1, lang_chars // 16 // SPREAD)
    reach = share + share // 2
    part = F.length(text) / F.lit(SPREAD)
    u = [F.pmod(F.xxhash64(F.lit("piece"), F.lit(i), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20)) for i in range(SPREAD)]
    spread = F.array(*[F.substring(text, (F.lit(1) + i * part + u[i] * (part - reach)).cast("int"), F.lit(reach)) for i in range(SPREAD)])
    pieces = F.when(F.length(text) <= SPREAD * reach, F.array(F.col(text))).otherwise(spread)
    parts = rows.select(F.col(lang).alias("l"), F.xxhash64(key).alias("h"), pieces.alias("t")).collect()
    texts: dict[str, str] = {}
    for row in sorted(parts, key=lambda r: (r["l"], r["h"], r["t"])):
        held = texts.get(row["l"], "")
        most = share * SPREAD // len(row["t"])
        drawn = " ".join(x for x in (letters(t)[:most].strip() for t in row["t"]) if x)
        texts[row["l"]] = (held + " " + drawn)[:lang_chars].strip() if len(held) < lang_chars else held
    return Model(texts)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row; see ``Model.predict``. Other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # bounded by learn()'s lang_chars for each language
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            lang, score = zip(*shared.value.predict(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_pydict({"k": part.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(key, text).mapInArrow(work, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.0, allowed: list[str] | None = None,
                    lang: str | None = None, sure: float = 0.6, evidence: int = 32) -> DataFrame:
    """The rows, with all columns, that hold a letter of the labelled texts and whose language is in ``allowed`` (default: any).

    A tie between languages is kept, as a short clean text is often one phrase in two of them; ``least``
    asks for a higher score. With ``lang``, that column becomes the identified language where it is null, or where
    it names another language of the model, the score is ``sure`` or more (0.6: any other language needs half as
    many bits again) and the text parses into ``evidence`` phrases or more (fewer may be a quotation that one language's
    labelled text holds); a label that no labelled text bears is left alone. A model without languages can't judge:
    every row stays as it is, and ``allowed`` is an error.
    """
    if not model.langs:
        if allowed is not None:
            raise ValueError("no labelled language was learned, so none can be asked for")
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    label = None if lang is None else docs.columns.index(lang)

    def wrong(old: str | None, t: str | None, pred: str, score: float) -> bool:
        known = shared.value
        return old in known.langs and old != pred and score >= sure and \
            known.phrases([known.encode(t)])[0, known.langs.index(pred)] >= evidence

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            texts = part.column(at).to_pylist()
            found = shared.value.predict(texts)
            if label is not None:
                own = part.column(label)
                named = [pred if pred != UNKNOWN and (old is None or wrong(old, t, pred, score)) else old
                         for old, t, (pred, score) in zip(own.to_pylist(), texts, found, strict=True)]
                part = part.set_column(label, part.schema.field(label), pa.array(named, own.type))
            yield part.filter(pa.array([pred != UNKNOWN and score >= least and (allowed is None or pred in allowed) and shared.value.holds(t)
                                        for t, (pred, score) in zip(texts, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


ship_by_value(__name__)
