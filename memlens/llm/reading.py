"""Reading level of English prose, by smoothed unigram language models per grade.

The models are trained on rated documents. A document's running prose is what is
left without headings, code, tables, lists of values and markup. Whether it is English prose is learnt
from the rated documents too: by the words that many of them share, and how much of a text these make up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.runtime import cut

#: Rated documents the models are fitted on at most (drawn by hash of the id), words of prose a case needs,
#: share of prose in a document that is mainly prose, additive smoothing.
RATED_DOCUMENTS, LEAST_WORDS, PROSE_SHARE, SMOOTHING = 50_000, 40, 0.5, 0.1
#: A word is common if it is in this share of the rated documents; a text is of their kind if its share of common words
#: reaches SLACK times the share that all but one in TAIL of them reach.
COMMON, SLACK, TAIL = 0.3, 0.7, 200

_FENCE = regex.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_FRONT = regex.compile(r"(?s)\A\s*---\s*\n.*?\n---\s*(?:\n|\Z)")
_SETEXT = regex.compile(r"(?m)^[^\n]*\n[ \t]*(?:={3,}|-{3,})[ \t]*$")
_TAG = regex.compile(r"<[^<>\n]{1,200}>")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:[-'’­​][\p{L}\p{M}]+)*")
_CODE = regex.compile(r"[{}=;|\\]|\w\(|_\w|::|^\[[\d:.]+\]|^\w+:\s|^\s*[|+]")
_ANY = regex.compile(r"\S+")


def prose_lines(text: str) -> list[str]:
    """Lines of running text: no fences, front matter, headings, tables, code or log lines."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    text = _SETEXT.sub("", _FRONT.sub("", _FENCE.sub("\n", text)))
    out = []
    for line in text.split("\n"):
        s = _TAG.sub(" ", line).strip()
        if not s or s[0] in "#|" or s.startswith(("===", "---", "$ ", ">>> ")):
            continue
        n, marks = len(_TOKEN.findall(s)), len(_CODE.findall(s))
        if n >= 3 and marks * 5 <= n:
            out.append(s)
    return out


class Gate:
    """Tells texts of the kind of the rated documents by their common words, which no list names."""

    def __init__(self, common: set[str], share: float):
        self.common, self.share = frozenset(common), share

    def of(self, words: list[str]) -> float:
        return sum(w in self.common for w in words) / max(1, len(words))

    def passes(self, words: list[str]) -> bool:
        return self.of(words) >= self.share


def prose_words(text: str | None, gate: Gate | None = None) -> list[str]:
    """Words of running prose, in lower case, if the text is mainly prose of enough words that passes the gate; else none."""
    if not text:
        return []
    lines = prose_lines(text)
    words = [w.lower().replace("\u200b", "").replace("\u00ad", "").replace("\u2019", "'") for s in lines for w in _TOKEN.findall(s)]
    if len(words) < LEAST_WORDS or len(words) < PROSE_SHARE * len(_ANY.findall(text)):
        return []
    return words if gate is None or gate.passes(words) else []


class GradeModel:
    """Log-likelihood of each word under each grade, for at most the words of RATED_DOCUMENTS documents."""

    def __init__(self, counts: pd.DataFrame, documents: pd.DataFrame, gate: Gate | None = None):
        self.gate = gate
        self.grades = sorted(int(g) for g in documents["grade"])
        place = {g: i for i, g in enumerate(self.grades)}
        vocabulary = sorted(set(counts["word"]))
        self.index = {w: i for i, w in enumerate(vocabulary)}
        table = np.zeros((len(vocabulary) + 1, len(self.grades)))
        if len(counts):
            table[counts["word"].map(self.index), counts["grade"].map(place)] = counts["n"]
        total = table.sum(0)
        self.logs = np.log((table + SMOOTHING) / (total + SMOOTHING * (len(vocabulary) + 1)))
        seen = documents.set_index("grade")["documents"].reindex(self.grades).to_numpy(float)
        self.prior = np.log((seen + 1) / (seen.sum() + len(seen)))

    def grade(self, words: list[str]) -> int | None:
        if not self.grades:
            return None
        count = Counter(self.index.get(w, -1) for w in words)
        count.pop(-1, None)  # unseen words say nothing about the grade
        at, n = np.fromiter(count, np.int64, len(count)), np.fromiter(count.values(), float, len(count))
        return self.grades[int((self.prior + n @ self.logs[at]).argmax())]


def consensus(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the grade most raters gave, ties to the middle of all grades then the lower one.

    Repeats of a rater count once; null grades and ids don't count.
    """
    once = labels.where("grade is not null and doc_id is not null").select("doc_id", "rater", "grade").distinct()
    votes = once.groupBy("doc_id", "grade").agg(F.count("*").alias("votes"))
    middle = once.groupBy("doc_id").agg(F.avg("grade").alias("middle"))
    best = F.struct(-F.col("votes"), F.abs(F.col("grade") - F.col("middle")), "grade")
    return votes.join(middle, "doc_id").groupBy("doc_id").agg(F.min(best).alias("b")).select("doc_id", F.col("b.grade").cast("int").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, most: int = RATED_DOCUMENTS) -> GradeModel:
    """Models of the grades and the gate. At most ``most`` rated documents are used, all of their words."""
    rated = consensus(labels)
    total = rated.count()
    if total > most:
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / total))
    own = cut(docs.select("doc_id", "text").join(rated, "doc_id").select("grade", "text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            by: dict[int, Counter] = {}
            inside: dict[int, Counter] = {}
            docs_of: Counter = Counter()
            for g, t in zip(pdf["grade"], pdf["text"]):
                if w := prose_words(t):
                    by.setdefault(int(g), Counter()).update(w)
                    inside.setdefault(int(g), Counter()).update(set(w))
                    docs_of[int(g)] += 1
            rows = [(g, w, n, inside[g][w]) for g, c in by.items() for w, n in c.items()] + [(g, None, n, n) for g, n in docs_of.items()]
            yield pd.DataFrame(rows, columns=["grade", "word", "n", "docs"]).astype({"grade": "int32", "n": "int64", "docs": "int64"})

    rows = own.mapInPandas(count, "grade int, word string, n bigint, docs bigint")
    pdf = rows.groupBy("grade", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    told = pdf["word"].isna()
    documents = pdf[told].rename(columns={"n": "documents"})[["grade", "documents"]]
    frequent = pdf[~told].groupby("word")["docs"].sum()
    gate = Gate(set(frequent[frequent >= COMMON * documents["documents"].sum()].index), 0.0)

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"share": [gate.of(w) for t in pdf["text"] if (w := prose_words(t))]}, dtype=float)

    tail = own.mapInPandas(shares, "share double").agg(F.percentile_approx("share", 1 / TAIL).alias("s")).first()["s"]
    return GradeModel(pdf[~told], documents, Gate(gate.common, SLACK * (tail or 0.0)))


def reading_levels(docs: DataFrame, model: GradeModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and grade (int) of every document that is mainly English prose of at least LEAST_WORDS words.

    Whole texts are read; null, empty and other texts give no row, copies a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in frames:
            grades = [m.grade(w) if (w := prose_words(t, m.gate)) else None for t in pdf["_text"]]
            out = pdf.drop(columns="_text").assign(grade=pd.array(grades, "Int32"))
            yield out[out["grade"].notna()]

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*docs.select(*keep).schema.fields]).add("grade", IntegerType())
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(run, schema)
