"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed
against it greedily: the longest prefix of the rest that occurs in the sample is one phrase. With c
phrases over n characters and a sample of N, c * log2(N) / n estimates the cross entropy; the
language needing fewest normalised phrases wins.

Following a phrase needs only the automaton's transitions, so they are kept as one array in which
the states' rows lie over each other (a cell names the state it belongs to), which takes no more room
for a large alphabet. Many pieces of texts (``BLOCK`` characters each; a phrase ends where its piece
ends) step together.

The sample: ``DOCS_PER_LANGUAGE`` documents a language, ``CHARS_PER_DOC`` characters of each (a
bound for fitting only; every text is scored whole). Every value of lang is learnt, with every
letter of its sample.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so is every text if there
is nothing to learn from. Ties go to the language first by name. Repeated rows keep one row each. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id_col, kept, table

DOCS_PER_LANGUAGE = 64
CHARS_PER_DOC = 320
BLOCK = 512
BATCH_CHARS = 1 << 20
#: Bases that are tried together when transitions are laid out.
SPAN = 64
LETTER = re.compile(r"[^\W\d_]")


def sample(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, chars_per_doc: int = CHARS_PER_DOC) -> dict[str, str]:
    """lang -> text to learn from, out of rows whose crc32 of the id is not 0 modulo 5."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (crc_of_id_col() % 5 != 0))
    h = F.xxhash64("doc_id", "lang")
    # for each (language, slot) the row of least hash; a pre-aggregated minimum, so a language of most rows is no hot task
    best = usable.select("lang", F.pmod(h, F.lit(docs_per_language)).alias("slot"), F.struct(h.alias("h"), F.substring("text", 1, chars_per_doc).alias("t")).alias("v")).groupBy("lang", "slot").agg(F.min("v").alias("v"))
    out: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "slot").collect():  # at most docs_per_language rows a language
        out.setdefault(r["lang"], []).append(r["v"]["t"])
    return {lang: "\n".join(parts) for lang, parts in sorted(out.items())}


def folded(text: str) -> str:
    return text.lower()


class Parser:
    """The automata of all languages in one array: the transition of state s by class c is in cell
    base[s] + c, if that cell's owner is s."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = [" ".join(re.findall(r"[^\W\d_]+", folded(samples[x]))) for x in self.languages]
        alphabet = sorted(set().union(*texts) - {" "})
        self.lookup = np.zeros(0x110000, np.int32)  # 0: blank and all that is no letter
        for i, c in enumerate(alphabet):
            self.lookup[ord(c)] = i + 1
        self.unknown = len(alphabet) + 1
        width = len(alphabet) + 2
        bases, owners, nexts, self.roots, at, cells = [], [], [], [], 0, 0
        self.first = np.zeros((len(texts), width), np.int64)  # language x class: where a phrase begins
        for j, text in enumerate(texts):
            n, state, code, to = automaton(self.codes(text))
            base, owner, following = overlaid(n, state, code, to, width)
            self.roots.append(at)
            self.first[j] = at
            self.first[j, code[state == 0]] = to[state == 0] + at
            bases.append(base + cells), owners.append(np.where(owner >= 0, owner + at, -1)), nexts.append(following + at)
            at += n
            cells += len(owner)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)
        self.base, self.owner, self.next = join(bases), join(owners), join(nexts)
        self.scale = np.array([np.log2(max(2, len(t))) for t in texts])

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.lookup[points]
        odd = np.flatnonzero((out == 0) & (points > 127))
        if len(odd):  # letters that no sample has are unlike blanks
            out[[i for i in odd if chr(points[i]).isalpha()]] = self.unknown
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed: text x language."""
        coded = [self.codes(folded(t)) for t in texts]
        lens = np.array([len(c) for c in coded], np.int64)
        k = len(self.languages)
        out = np.zeros((len(texts), k), np.int64)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
        per = -(-lens // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = starts[owner] + nth * BLOCK
        size = np.minimum(BLOCK, lens[owner] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        at, size, owner = at[order], size[order], owner[order]
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(at), 1)
        count = np.zeros((k, len(at)), np.int32)
        live = len(at)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size[:live], -step, "left"))
            c = flat[at[:live] + step]
            was = state[:, :live]
            cell = self.base[was] + c
            ended = self.owner[cell] != was
            count[:, :live] += ended
            state[:, :live] = np.where(ended, self.first[:, c], self.next[cell])
        count += 1  # the phrase that the end closes
        for j in range(k):
            out[:, j] = np.bincount(owner, weights=count[j], minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        lo = 0
        while lo < len(todo):
            hi, chars = lo, 0
            while hi < len(todo) and (hi == lo or chars + len(texts[todo[hi]]) <= BATCH_CHARS):
                chars += len(texts[todo[hi]])
                hi += 1
            own = todo[lo:hi]
            n = np.array([len(texts[i]) for i in own], float)
            h = self.phrases([texts[i] for i in own]) * self.scale / n[:, None]
            best = h.argmin(1)
            e = np.exp2(-(h - h.min(1, keepdims=True)) * np.minimum(n, 400)[:, None] / 8)
            score = 1 / e.sum(1)
            for i, b, s in zip(own, best, score, strict=True):
                out[i] = (self.languages[b], float(s))
            lo = hi
        return out


def automaton(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a string of classes: its number of states, and each transition's
    state, class and following state."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    state = np.repeat(np.arange(len(nxt)), [len(edges) for edges in nxt])
    code, to = (np.fromiter(chain.from_iterable(x), np.int64, len(state)) for x in (nxt, (edges.values() for edges in nxt)))
    return len(nxt), state, code, to


def overlaid(n: int, state: np.ndarray, code: np.ndarray, to: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of each state, owner and following state of each cell). States of several transitions
    take the first base, from where room is left, at which all their cells are free; those of one
    transition then fill the free cells. ``width`` spare cells at either end keep every look inside."""
    degree = np.bincount(state, minlength=n)
    ends = np.cumsum(degree)
    base = np.full(n, width, np.int64)
    taken = np.zeros(3 * width + 2 * len(state) + SPAN, bool)
    taken[:width] = True
    low = width
    several = np.flatnonzero(degree > 1)
    for s in several[np.argsort(-degree[several], kind="stable")].tolist():
        own = code[ends[s] - degree[s] : ends[s]]
        at = max(0, low - int(own.min()))
        while True:
            if at + width + SPAN > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            free = np.flatnonzero(~taken[own[:, None] + np.arange(at, at + SPAN)].any(0))
            if len(free):
                break
            at += SPAN
        base[s] = at + free[0]
        taken[base[s] + own] = True
        if at > low:  # nothing fitted into the first span: it is left to single transitions
            low += SPAN
    single = np.flatnonzero(degree == 1)
    if len(single):
        room = np.flatnonzero(~taken[: int(np.flatnonzero(taken)[-1]) + 1])
        room = np.concatenate([room, int(np.flatnonzero(taken)[-1]) + 1 + np.arange(max(0, len(single) - len(room)))])
        base[single] = room[: len(single)] - code[ends[single] - 1]
    cell = base[state] + code
    size = int(max(cell.max(initial=0), base.max())) + width + 1
    owner, following = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    owner[cell], following[cell] = state, to
    return base, owner, following


def parser_of(samples: dict[str, str]) -> Parser:
    return kept(("automata", *samples.items()), lambda: Parser(samples))


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            found = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", (crc_of_id_col() % 5 == 0).alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text is in a language that was learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            found = parser.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([lang != "und" for lang, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, sample(docs))
