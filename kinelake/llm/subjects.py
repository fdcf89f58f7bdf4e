"""Subject areas of documents by one-versus-rest linear classifiers.

Method.  Sentences are hashed to word uni- and bigrams.  One linear
(logistic) classifier per subject is fitted, first on the labelled examples,
then in a few rounds also on weakly labelled sentences of a bounded sample of
documents.  The documents carry no address paths and their section headings
are bare numbers, so the weak label of a sentence comes from its section (a
paragraph, or a run of one-sentence lines): the neighbouring sentences' scores,
its own counting less, never across a section's end.  Sentences that occur
among all subjects thereby learn to score low everywhere.

Every classifier's threshold is one that is good on the labelled examples,
each scored by a model that was fitted without it, and among those the one
that agrees best with clear neighbourhoods over all documents; a sentence
counts for every subject whose threshold it passes.  A document gets every subject whose
sentences make up a real share of it.  Fenced text is scored like any other.

The sample only serves to fit, and a fifth of it is kept out of the fit; every
document is scored, over its whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import map_arrow, spread

#: A number's full stop ends a sentence only before a capital letter.
SENTENCE_END = re.compile(r"(?<=[^\d\s][.!?…])\s+|(?<=\d[.!?…])\s+(?=[^\W\d_a-zçğıöşüäßáéíóúñ])|[\r\n]+|</?\w[^>]*>")
CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
FENCE = re.compile(r"^\s*```")
HEADING = re.compile(r"^\s*(?:#+\s.*|[\W\d_]*)$")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Runs of characters that UTF-8 bytes turn into when they are read as a Western one-byte code page.
MISREAD = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201a\u201c-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}")
WORD = re.compile(r"[^\W\d_]+")
#: Candidate thresholds of a sentence's score.
LEVELS = np.arange(0.3, 0.71, 0.05)
#: Classifiers that one model may hold: 2 ** hash_bits weights each go to every worker.
MOST_SUBJECTS = 1024


@dataclass(frozen=True)
class SubjectParams:
    hash_bits: int = 17
    sample_docs: int = 6000  #: documents whose sentences give weak labels (fitting only)
    sample_examples: int = 20_000  #: labelled examples used (fitting and thresholds)
    folds: int = 2  #: models that score the labelled examples they were not fitted on
    rounds: int = 4
    epochs: int = 6
    rate: float = 0.5
    decay: float = 1e-6
    reach: int = 4  #: sentences on each side that give a sentence its weak label
    own: float = 0.3  #: weight of the sentence's own earlier score in it
    least_share: float = 0.15  #: of the subject-bearing text
    least_sentences: int = 3  #: of a subject, unless the text is short:
    short_share: float = 0.3  #: of all sentences of the text, fenced lines about nothing left out
    pair_share: float = 0.2  #: of its subject-bearing sentences, from which two suffice
    seed: int = 11


def _reread(m: re.Match) -> str:
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return m.group()
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def _clean(text: str) -> str:
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", MISREAD.sub(_reread, text)))


def _split(text: str) -> list[str]:
    return [s for s in (p.strip() for p in SENTENCE_END.split(text)) if s]


def sentences(text: str) -> list[str]:
    """Sentences of a text's prose with composed letters, without invisible
    characters and fenced code, misread encodings undone."""
    return _split(_clean(CODE.sub("\n", text)))


def pieces(text: str) -> list[tuple[str, int, bool]]:
    """All sentences and fenced lines of a text in order, each with the number
    of its section and whether it is fenced.  A section ends at a heading, an
    empty line, a fence, and where a line of several sentences begins or ends."""
    out: list[tuple[str, int, bool]] = []
    section, fenced, many = 0, False, False
    for line in _clean(text).splitlines():
        if FENCE.match(line):
            fenced, many = not fenced, False
            section += 1
            line = line.replace("```", " ")
        found = _split(line)
        if not fenced:
            if HEADING.match(line):
                section, many = section + 1, False
            elif many or len(found) > 1:
                section += 1
            many = len(found) > 1
        out += [(f, section, fenced) for f in found]
    return out


def _sections(parts: list[list[tuple[str, int, bool]]]) -> np.ndarray:
    """Running number of the section of every sentence of several texts."""
    place = np.array([(d, section) for d, found in enumerate(parts) for _, section, _ in found], np.int64).reshape(-1, 2)
    return np.cumsum(np.append([0], np.any(place[1:] != place[:-1], axis=1))) if len(place) else np.zeros(0, np.int64)


@lru_cache(maxsize=1 << 17)
def _bucket(gram: str, bits: int) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) & ((1 << bits) - 1)


def features(sentence: str, bits: int) -> list[int]:
    words = WORD.findall(sentence.lower())
    return [_bucket(w, bits) for w in words] + [_bucket(a + " " + b, bits) for a, b in zip(words, words[1:])]


class Sparse:
    """Rows of hashed features in CSR form, each row scaled to unit length."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.n = len(rows)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.length)])
        self.idx = np.fromiter((i for r in rows for i in r), np.int64, int(self.ptr[-1]))
        self.scale = 1 / np.sqrt(np.maximum(self.length, 1)).astype(np.float32)

    def scores(self, w: np.ndarray, bias: np.ndarray, step: int = 20_000) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]), np.float32)
        for a in range(0, self.n, step):
            b = min(self.n, a + step)
            lo, hi = self.ptr[a], self.ptr[b]
            if hi > lo:
                full = np.flatnonzero(self.length[a:b]) + a
                out[full] = np.add.reduceat(w[self.idx[lo:hi]], self.ptr[full] - lo, axis=0) * self.scale[full, None]
        return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices of the rows and the position in ``rows`` of each."""
        length = self.length[rows]
        at = np.repeat(self.ptr[rows] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return self.idx[at], np.repeat(np.arange(len(rows)), length)


def train(x: Sparse, y: np.ndarray, weight: np.ndarray, p: SubjectParams) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the weighted log loss; y holds a target in [0, 1] per subject."""
    dim, k = 1 << p.hash_bits, y.shape[1]
    w, bias = np.zeros((dim, k), np.float32), np.full(k, -1.5, np.float32)
    g2, b2 = np.full((dim, k), 1e-3, np.float32), np.full(k, 1e-3, np.float32)
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        order = rng.permutation(x.n)
        for at in range(0, x.n, 2048):
            rows = order[at : at + 2048]
            idx, owner = x.take(rows)
            scale = x.scale[rows]
            z = np.zeros((len(rows), k), np.float32)
            for c in range(k):
                z[:, c] = np.bincount(owner, w[idx, c], len(rows)) * scale
            err = (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y[rows]) * weight[rows, None]
            used, inverse = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(inverse, (err[:, c] * scale)[owner], len(used)) for c in range(k)], 1).astype(np.float32)
            grad += p.decay * len(rows) * w[used]
            g2[used] += grad * grad
            w[used] -= p.rate * grad / np.sqrt(g2[used])
            gb = err.sum(0)
            b2 += gb * gb
            bias -= p.rate * 0.2 * gb / np.sqrt(b2)
    return w, bias


def _context(prob: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Mean score of the neighbours within reach in the same section ``doc``, without the sentence itself."""
    total = np.zeros_like(prob)
    count = np.zeros(len(prob))
    for d in range(1, reach + 1):
        same = doc[d:] == doc[:-d]
        w = 1.0 / d
        total[d:][same] += w * prob[:-d][same]
        count[d:][same] += w
        total[:-d][same] += w * prob[d:][same]
        count[:-d][same] += w
    return np.where(count[:, None] > 0, total / np.maximum(count, 1e-9)[:, None], np.nan)


def _weak(prob: np.ndarray, doc: np.ndarray, p: SubjectParams) -> tuple[np.ndarray, np.ndarray]:
    """Weak label of each sentence from its neighbourhood, and how far to trust it."""
    # sharpen towards the leading subject; sentences without any evidence stay undecided
    lead = prob / np.maximum(prob.sum(1, keepdims=True), 1e-9)
    strong = np.where(prob.max(1, keepdims=True) >= 0.25, lead**2 / (lead**2).sum(1, keepdims=True), 0.0)
    near = _context(strong, doc, p.reach)
    known = (1 - p.own) * np.nan_to_num(near) + p.own * strong
    return known / np.maximum(known.sum(1, keepdims=True), 1e-9), known.max(1) * (known.sum(1) > 0.3)


@dataclass
class SubjectModel:
    subjects: list[str]
    w: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    params: SubjectParams

    def shares(self, texts: list[str | None]) -> list[dict[str, float]]:
        """Subjects of each text with their share of its subject-bearing characters."""
        p = self.params
        parts = [pieces(t) if t else [] for t in texts]
        x = Sparse([features(s, p.hash_bits) for d in parts for s, _, _ in d])
        prob = x.scores(self.w, self.bias)
        # beside its best subject a sentence counts for those whose classifier finds them likelier than not
        best = prob >= prob.max(1, keepdims=True) if len(prob) else prob
        sure = prob >= np.where(best, self.thresholds, np.maximum(self.thresholds, 0.5))
        out, at = [], 0
        for d in parts:
            said = sure[at : at + len(d)]
            at += len(d)
            length = np.array([len(s) for s, _, _ in d], float)
            bearing = said.any(1) if len(d) else np.zeros(0, bool)
            total = length[bearing].sum()
            count = said.sum(0)
            share = (length[:, None] * said).sum(0) / total if total else np.zeros(len(self.subjects))
            n = sum(1 for (_, _, fenced), k in zip(d, bearing) if k or not fenced)
            pair = (count >= 2) & (count >= p.pair_share * bearing.sum())
            keep = (share >= p.least_share) & ((count >= p.least_sentences) | ((count > 0) & (count >= p.short_share * n)) | pair)
            out.append({self.subjects[k]: float(share[k]) for k in np.flatnonzero(keep)})
        return out


def _sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows in a hash order of the key; only about n leave the tasks."""
    h = F.xxhash64(key)
    share = (n + 6 * n**0.5 + 40) / max(1, rows.count())
    return (rows.where(h < int(share * 2**64) - 2**63) if share < 1 else rows).orderBy(h, key).limit(n)


def fit_subjects(examples: DataFrame, documents: DataFrame, areas: DataFrame, params: SubjectParams = SubjectParams()) -> SubjectModel:
    """Fit on at most ``sample_examples`` labelled examples and ``sample_docs``
    documents, taken in a hash order of their ids; thresholds come from the
    examples and all documents.  Examples without subject or text, and with a subject that
    ``areas`` lacks, are left out."""
    p = params
    subjects = sorted(r["subject"] for r in areas.select("subject").distinct().limit(MOST_SUBJECTS + 1).collect() if r["subject"])
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects: fit several models")
    code = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    labelled = _sample(examples.where("text is not null and subject is not null"), "example_id", p.sample_examples) if "example_id" in examples.columns else examples.where("text is not null and subject is not null").limit(p.sample_examples)
    shown = [(s, code[r["subject"]], i) for i, r in enumerate(labelled.select("subject", "text").collect()) if r["subject"] in code for s, _, _ in pieces(r["text"])]
    if not shown or not k:
        return SubjectModel(subjects, np.zeros((1 << p.hash_bits, k), np.float32), np.full(k, -30, np.float32), np.ones(k), p)
    texts = [r["text"] for r in _sample(documents.where("text is not null and trim(text) <> ''").select("doc_id", "text"), "doc_id", p.sample_docs).toLocalIterator()]
    parts = [pieces(t) for t in texts]
    doc, section = np.repeat(np.arange(len(parts)), [len(d) for d in parts]), _sections(parts)
    x_show = [features(s, p.hash_bits) for s, _, _ in shown]
    y_show = np.zeros((len(shown), k), np.float32)
    y_show[np.arange(len(shown)), [c for _, c, _ in shown]] = 1
    x_docs = [features(s, p.hash_bits) for d in parts for s, _, _ in d]
    w, bias = train(Sparse(x_show), y_show, np.ones(len(shown), np.float32), p)
    if not x_docs:
        return SubjectModel(subjects, w, bias, np.full(k, 0.5), p)
    inner = Sparse(x_docs)
    held = doc % 5 == 0
    both = Sparse(x_show + [r for r, h in zip(x_docs, held) if not h])
    for _ in range(p.rounds):
        labeller = (w, bias)
        target, trust = _weak(inner.scores(w, bias), section, p)
        y = np.concatenate([y_show, target[~held].astype(np.float32)])
        weight = np.concatenate([np.full(len(shown), 2.0), trust[~held]]).astype(np.float32)
        w, bias = train(both, y, weight, p)
    allowed = held_out_levels(both, y, weight, np.array([i % p.folds for _, _, i in shown]), p)
    return SubjectModel(subjects, w, bias, calibrate(documents, labeller, (w, bias), allowed, k, p), p)


def held_out_levels(x: Sparse, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, p: SubjectParams) -> np.ndarray:
    """Per subject the levels whose F measure on the labelled sentences (the
    first ``len(fold)`` rows), each scored by a model fitted without its fold,
    is as good as the best, but for the error of a share among so few."""
    n = len(fold)
    prob = np.zeros((n, y.shape[1]), np.float32)
    for f in range(p.folds):
        out = np.flatnonzero(fold == f)
        seen = weight.copy()
        seen[out] = 0
        w, bias = train(x, y, seen, p)
        prob[out] = x.scores(w, bias)[out]
    wanted = y[:n] > 0.5
    f = [2 * ((prob >= th) & wanted).sum(0) / np.maximum(1, (prob >= th).sum(0) + wanted.sum(0)) for th in LEVELS]
    return np.stack(f, 1) >= np.max(f, 0)[:, None] - 1 / np.sqrt(np.maximum(1, wanted.sum(0)))[:, None]


def calibrate(documents: DataFrame, labeller: tuple[np.ndarray, np.ndarray], model: tuple[np.ndarray, np.ndarray], shown: np.ndarray, k: int, p: SubjectParams) -> np.ndarray:
    """Per subject the threshold with the best agreement with clear neighbourhoods,
    over all documents, among those that ``shown`` allows; of equally good ones
    the strictest.

    ``labeller`` gives the weak labels, ``model`` the scores to cut.  Only
    counts per subject, level of the score and agreement leave a task."""
    shared = documents.sparkSession.sparkContext.broadcast((labeller, model))  # bounded: 2 ** hash_bits weights per subject, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = shared.value
        n = np.zeros((k, len(LEVELS) + 1, 2), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                parts = [pieces(t) for t in b.slice(at, 500).column(0).to_pylist()]
                section = _sections(parts)
                if not len(section):
                    continue
                x = Sparse([features(s, p.hash_bits) for d in parts for s, _, _ in d])
                target, trust = _weak(x.scores(*first), section, p)
                level = np.searchsorted(LEVELS, x.scores(*last), "right")
                clear = np.flatnonzero(trust > 0.6)
                meant = target[clear].argmax(1)
                for c in range(k):
                    np.add.at(n, (c, level[clear, c], (meant == c).astype(int)), 1)
        c, v, right = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(v, pa.int32()), pa.array(right, pa.int32()), pa.array(n[c, v, right], pa.int64())], ["subject", "level", "right", "n"])

    texts = documents.where("text is not null and trim(text) <> ''").select("text")
    hist = map_arrow(spread(texts), run, "subject int, level int, right int, n bigint").groupBy("subject", "level", "right").agg(F.sum("n").alias("n"))
    count = np.zeros((k, len(LEVELS) + 1, 2), np.int64)
    for r in hist.collect():  # at most 2 * (len(LEVELS) + 1) rows per subject
        count[r["subject"], r["level"], r["right"]] = r["n"]
    thresholds = np.full(k, 0.5)
    for c in range(k):
        best = -1.0
        for i in np.flatnonzero(shown[c]):
            said, right, wanted = count[c, i + 1 :].sum(), count[c, i + 1 :, 1].sum(), count[c, :, 1].sum()
            f = 2 * right / max(1, said + wanted)
            if f >= best - 1e-9:
                best, thresholds[c] = f, LEVELS[i]
    return thresholds


def document_subjects(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """doc_id, subject, share for every subject of every document.

    A null, empty or contentless text has no subject and no row; repeated
    rows come out repeated; rows with a null doc_id are scored like others;
    other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(documents.dtypes)["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded: 2 ** hash_bits weights per subject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = m.shares(part.column(1).to_pylist())
                rows = [(i, s, v) for i, d in enumerate(got) for s, v in d.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "subject", "share"])

    return map_arrow(spread(documents.select("doc_id", "text")), run, f"doc_id {kind}, subject string, share double")
