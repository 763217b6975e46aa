"""Retrieval: BM25 over prefixes, exact cosine top-k, rank fusion and hybrid search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlens.functions.text import has_tags, plain_tokens, query_terms, stemmed_tokens
from memlens.runtime import cut, new_table, skew_join, small

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, W_VECTOR, W_TEXT = 60, 0.7, 0.3
SHADOW_K = (3, 5, 10, 20)
TEXT_COLUMNS = ("context", "action", "result")
#: Postings dealt to one task, tokens of queries in one broadcast block, cells of scores that a task holds at once.
TASK_POSTINGS, BLOCK_TOKENS, SCORE_CELLS = 1 << 20, 1 << 21, 1 << 22
#: Rows of a group whose best score is looked at first, cells of weights held densely, and the share (one in so many of all pairs of a query and a row) that
#: a token has to touch for its weights to be held so.
GROUP_ROWS, DENSE_CELLS, DENSE_SHARE = 64, 1 << 23, 256


# -- BM25

def _tokens(text: Column, stem: bool) -> Column:
    return stemmed_tokens(text) if stem else plain_tokens(text)


def postings(memories: DataFrame, stem: bool = True, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(id, term, tf, len): the inverted index over all rows, superseded ones included; null texts count as empty."""
    words = memories.select("id", _tokens(F.concat_ws(" ", *columns), stem).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


class TextIndex:
    """A kept full-text index: postings and lengths in segments of a folder, so that a search reads and does not build it.

    An update is a new segment; rows that changed or went are told apart by a table of the dead, until :meth:`compact`
    writes everything as one segment again. With ``stem`` terms are folded and stemmed, else they are lower-case runs of letters and digits.
    """

    def __init__(self, spark: SparkSession, path: str, stem: bool, segments: list[str], dead: list[str]):
        self.spark, self.path, self.stem, self.segments, self.dead = spark, path, stem, segments, dead

    @classmethod
    def build(cls, memories: DataFrame, stem: bool = True, path: str | None = None) -> TextIndex:
        self = cls(memories.sparkSession, path or new_table(memories.sparkSession), stem, [], [])
        self._segment(memories)
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        state = spark.read.parquet(f"{path}/state").orderBy(F.desc("version")).first()
        return cls(spark, path, state["stem"], list(state["segments"]), list(state["dead"]))

    def _save(self) -> None:
        row = [(len(self.segments) + len(self.dead), self.stem, self.segments, self.dead)]
        self.spark.createDataFrame(row, "version int, stem boolean, segments array<string>, dead array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _segment(self, memories: DataFrame) -> None:
        name = uuid.uuid4().hex
        text = _tokens(F.concat_ws(" ", *TEXT_COLUMNS), self.stem)
        whole = memories.select("id", text.alias("t")).select("id", F.size("t").cast("long").alias("len"), F.explode_outer("t").alias("term"))
        # a row of its own length for every id; the null term of a row without tokens keeps it
        whole.groupBy("id", "term").agg(F.count("term").alias("tf"), F.first("len").alias("len")).write.parquet(f"{self.path}/{name}/postings")
        memories.select("id", F.size(text).cast("long").alias("len")).write.parquet(f"{self.path}/{name}/rows")
        self.segments.append(name)
        self._save()

    def _live(self, part: str) -> DataFrame:
        out = None
        for k, name in enumerate(self.segments):
            df = self.spark.read.parquet(f"{self.path}/{name}/{part}").withColumn("_at", F.lit(k))
            out = df if out is None else out.unionByName(df)
        if self.dead:
            gone = self.spark.read.parquet(*[f"{self.path}/{n}" for n in self.dead]).groupBy("id").agg(F.max("before").alias("before"))
            out = out.join(small(gone), "id", "left").where("before is null or _at >= before").drop("before")
        return out.drop("_at")

    def postings(self) -> DataFrame:
        return self._live("postings").where("term is not null").select("id", "term", "tf", "len")

    def corpus(self) -> DataFrame:
        """One row: n (all rows) and mean (tokens a row)."""
        return self._live("rows").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows of ``changed`` take the place of those of the same id; ids of ``gone`` (id) leave."""
        ids = changed.select("id") if gone is None else changed.select("id").unionByName(gone.select("id"))
        name = f"dead-{uuid.uuid4().hex}"
        ids.distinct().select("id", F.lit(len(self.segments)).alias("before")).write.parquet(f"{self.path}/{name}")
        self.dead.append(name)
        self._segment(changed)

    def compact(self) -> None:
        """One segment of what is alive."""
        name = uuid.uuid4().hex
        for part in ("postings", "rows"):
            self._live(part).write.parquet(f"{self.path}/{name}/{part}")
        self.segments, self.dead = [name], []
        self.spark.createDataFrame([(2**31 - 1, self.stem, self.segments, self.dead)], "version int, stem boolean, segments array<string>, dead array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state")


def query_tokens(queries: DataFrame, stem: bool = True, terms: Callable[[Column], Column] = query_terms) -> DataFrame:
    """(query_id, pos, token): a row for each token, repeated ones too."""
    parts = queries.select("query_id", F.posexplode(terms(F.col("query"))).alias("pos", "word"))
    if stem:
        return parts.select("query_id", "pos", F.explode(stemmed_tokens(F.col("word"))).alias("token"))
    return parts.select("query_id", "pos", F.lower("word").alias("token"))


def prefix_matches(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term, token) for every term (term) that begins with a token (token): an equi-join of the tokens with the terms' prefixes of their lengths."""
    lengths = [r[0] for r in tokens.select(F.length("token").alias("n")).distinct().collect()]
    own = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("term"))
    prefixes = terms.select("term", F.explode(F.transform(own, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("token"))
    return prefixes.join(tokens.select("token"), "token").select("term", "token")


def bm25(memories: DataFrame | TextIndex, tokens: DataFrame, k: int | None, stem: bool = True) -> DataFrame:
    """(query_id, id, rank, pos): best ``k`` rows a query by BM25 (rank is negative, lower is better), ties to the smaller id.

    A token matches every term it is a prefix of. Document frequency counts the rows a token matches. Equal tokens are scored once and
    weighted by their number. Pass a :class:`TextIndex` to search what is kept; of memories an index is built first.
    Without ``k`` all matching rows come, unordered. Ids are told as text.
    """
    index = memories if isinstance(memories, TextIndex) else TextIndex.build(memories, stem)
    words = cut(tokens.groupBy("query_id", "token").agg(F.count("*").alias("times")))
    posts = index.postings()
    matches = prefix_matches(posts.select("term").distinct(), words.select("token").distinct())
    tf = cut(skew_join(posts, matches, ["term"]).groupBy("token", "id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len")))
    df = cut(tf.groupBy("token").agg(F.count("*").alias("df")))
    stats = F.broadcast(index.corpus())  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = skew_join(tf, df, ["token"]).crossJoin(stats).select("token", F.col("id").cast("string").alias("id"), weight.alias("w"))
    asked = words.join(df.select("token"), "token", "left_semi")
    if k is None:
        return skew_join(scored, asked, ["token"]).groupBy("query_id", "id").agg((-F.sum(F.col("w") * F.col("times"))).alias("rank"))
    return _best(asked, scored, k, tf.count())


def _best(asked: DataFrame, scored: DataFrame, k: int, total: int) -> DataFrame:
    """(query_id, id, rank, pos) of the best ``k`` rows of each query, from those that each task holds.

    Rows are dealt to tasks with all their postings, about TASK_POSTINGS each, and the stated queries are broadcast in blocks. A task adds up
    the scores of its rows for some queries at a time, so nothing is shuffled by token and k rows a task and query are left.
    """
    # queries and tokens go by number, so that what the driver and the tasks hold of them is small
    names = cut(asked.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()))
    codes = cut(asked.select("token").distinct().withColumn("code", F.monotonically_increasing_id()))
    entries = cut(skew_join(skew_join(asked, names, ["query_id"]), codes, ["token"]).select("q", "code", "times"))
    parts = max(1, -(-entries.count() // BLOCK_TOKENS))
    dealt = skew_join(scored, codes, ["token"]).select("code", "id", "w").repartition(max(8, -(-total // TASK_POSTINGS)), "id")
    out: DataFrame | None = None
    for part in range(parts):
        block = entries if parts == 1 else entries.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        best = _best_of_block(dealt, block.toArrow().to_pandas(), k)
        out = best if out is None else out.unionByName(best)
    best = top(out.select("q", "id", (-F.col("score")).alias("rank")), k, [F.round("rank", 9).asc()], by="q")
    return best.join(small(names), "q").select("query_id", "id", "rank", "pos")


def _best_of_block(scored: DataFrame, block: pd.DataFrame, k: int) -> DataFrame:
    queries, of = np.unique(block["q"].to_numpy(), return_inverse=True)
    tokens, code = np.unique(block["code"].to_numpy(), return_inverse=True)
    by = np.argsort(of, kind="stable")
    shared = scored.sparkSession.sparkContext.broadcast((queries, tokens, of[by].astype(np.int32), code[by].astype(np.int32), block["times"].to_numpy(np.float32)[by]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, tokens, of, code, times = shared.value
        held = [pdf for pdf in frames if len(pdf)]
        if not held or not len(queries):
            return
        pdf = pd.concat(held)
        kind, ids = pd.factorize(pdf["id"].to_numpy())
        by = np.argsort(ids)  # rows stand in the order of their ids; only the distinct ones are sorted
        ids, row = ids[by], np.argsort(by)[kind]
        at = np.searchsorted(tokens, pdf["code"].to_numpy())
        known = (at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == pdf["code"].to_numpy())
        at, row, w = at[known], row[known], pdf["w"].to_numpy()[known]
        order = np.lexsort((row, at))
        yield from _best_rows(queries, of.astype(np.int64), code.astype(np.int64), times.astype(float), ids, at[order], row[order], w[order], len(tokens), k)

    return scored.select("code", "id", "w").mapInPandas(run, "q long, id string, score double")


def _best_rows(queries: np.ndarray, of: np.ndarray, code: np.ndarray, times: np.ndarray, ids: np.ndarray, at: np.ndarray, row: np.ndarray, w: np.ndarray, kinds: int, k: int) -> Iterator[pd.DataFrame]:
    """Frames (q, id, score) of the best ``k`` of the rows ``ids`` for each query, some queries at a time.

    Entries (``of``, ``code``, ``times``) are the tokens of the queries, by query; postings (``at``, ``row``, ``w``) are by token and row. Scores are
    screened in single precision: tokens of many queries and rows by one product, others posting by posting. All rows that the
    bound of its error leaves are then summed in double precision, token by token, so that equal rows have equal scores.
    """
    begin = np.searchsorted(at, np.arange(kinds + 1))
    size = np.diff(begin)
    first = np.searchsorted(of, np.arange(len(queries) + 1))
    groups = max(1, -(-len(ids) // GROUP_ROWS))
    width = groups * GROUP_ROWS
    often = np.flatnonzero(np.bincount(code, minlength=kinds) * size * DENSE_SHARE > len(queries) * len(ids))
    often = often[np.argsort(-size[often], kind="stable")][: max(1, DENSE_CELLS // width)]
    place = np.full(kinds, -1)
    place[often] = np.arange(len(often))
    weight = np.zeros((len(often), width))
    known = place[at] >= 0
    weight[place[at[known]], row[known]] = w[known]
    fast, key, w4 = weight.astype(np.float32), at * len(ids) + row, w.astype(np.float32)
    slack = 3 * (np.diff(first).max(initial=0) + 4) * 1.2e-7  # of sums of positive numbers in single precision, twice and then some
    rare = np.where(place[code] < 0, size[code], 0)
    work = np.concatenate([[0], np.cumsum(rare)])[first]
    q = 0
    while q < len(queries):
        # as many queries as keep the cells and the postings of the step bounded
        end = max(q + 1, min(q + max(1, SCORE_CELLS // width), int(np.searchsorted(work, work[q] + SCORE_CELLS, side="right")) - 1))
        own = slice(first[q], first[end])
        who, what, many = of[own] - q, code[own], times[own]
        asked = np.zeros((end - q, len(often)), np.float32)
        dense = place[what] >= 0
        asked[who[dense], place[what[dense]]] = many[dense]
        s = asked @ fast
        for i, t, m in zip(who[~dense].tolist(), what[~dense].tolist(), many[~dense].tolist()):
            mine = slice(begin[t], begin[t + 1])
            s[i, row[mine]] += w4[mine] if m == 1 else w4[mine] * np.float32(m)
        # the k-th best of the groups' best is no better than the k-th best row
        best = s.reshape(end - q, GROUP_ROWS, groups).max(1)
        least = np.partition(best, groups - k, axis=1)[:, groups - k] * (1 - slack) - 1e-7 if groups > k else np.zeros(end - q)
        r, g = np.nonzero((best >= least[:, None]) & (best > 0))
        for i in range(0, len(r), 1 << 12):
            rows, cols = r[i : i + (1 << 12)], g[i : i + (1 << 12), None] + np.arange(GROUP_ROWS) * groups
            value = s[rows[:, None], cols]
            at_, j = np.nonzero((value >= least[rows][:, None]) & (value > 0))
            part = (rows[at_], cols[at_, j], value[at_, j])
            found = part if not i else tuple(np.concatenate(x) for x in zip(found, part))
        if len(r):
            r, c, value = found
            by = np.lexsort((-value, r))
            r, c, value = r[by], c[by], value[by]
            last = np.searchsorted(r, r) + k - 1
            last = np.where(last < np.searchsorted(r, r, side="right"), last, -1)
            near = (last < 0) | (value >= value[last] * (1 - slack) - 1e-7)
            r, c = r[near], c[near]
            score = np.empty(len(r))
            step = max(1, (1 << 20) // int(np.diff(first).max()))
            for i in range(0, len(r), step):
                mine, cols = r[i : i + step], c[i : i + step]
                n = first[q + mine + 1] - first[q + mine]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[q + mine], n)
                token, col = code[entry], np.repeat(cols, n)
                dense = place[token] >= 0
                value = np.zeros(len(entry))
                value[dense] = weight[place[token[dense]], col[dense]]
                wanted = token[~dense] * len(ids) + col[~dense]
                spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                value[~dense] = np.where(key[spot] == wanted, w[spot], 0)
                score[i : i + step] = np.bincount(np.repeat(np.arange(len(mine)), n), value * times[entry], len(mine))
            by = np.lexsort((c, -score.round(9), r))
            r, c, score = r[by], c[by], score[by]
            ok = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield pd.DataFrame({"q": queries[q + r[ok]], "id": ids[c[ok]], "score": score[ok]})
        q = end


def top(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """First ``k`` rows of each ``by`` with their place ``pos``; ties to the smaller id."""
    w = Window.partitionBy(by).orderBy(*order, F.col("id").asc())
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


# -- vectors

#: Bytes of the query block that one broadcast may hold.
QUERY_BYTES = 32 << 20
#: Cells of a block of cosines that :func:`all_near` holds at once.
NEAR_CELLS = 1 << 20


def knn(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, per_id: int = 1) -> DataFrame:
    """(query_id, id, sim, pos): exact best ``k`` by cosine for each query, ties to the smaller id.

    ``vectors`` (id, vec) and ``queries`` (query_id, vec) hold float arrays; a zero vector has cosine 0,
    nulls and other widths than the query's are skipped. An id may have up to ``per_id`` vectors, the best of which counts. Cosines are
    compared to nine digits, and equal vectors have equal ones. The stated queries are broadcast in blocks and every task
    keeps its own best, so ``k * per_id`` rows a task and query are shuffled.
    """
    total, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id string, id string, sim double, pos int")
    parts = -(-total * (8 * max(width, 1) + 64) // QUERY_BYTES)
    out: DataFrame | None = None
    for part in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        best = _knn_block(vectors, block.select(F.col("query_id").cast("string"), "vec").where("vec is not null").toPandas(), k * per_id, least)
        out = best if out is None else out.unionByName(best)
    if per_id > 1:
        out = out.groupBy("query_id", "id").agg(F.max("sim").alias("sim"))
    return top(out, k, [F.round("sim", 9).desc()])


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


#: Slack of the blocked product, whose last bits depend on the block, before cosines are summed row by row.
SCREEN = 1e-9


def _best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the best ``k`` rows of each query; of equal vectors only the ``k`` smallest ids can be among them."""
    _, kind = np.unique(x, axis=0, return_inverse=True)
    by = np.lexsort((ids, kind.reshape(-1)))
    kind = kind.reshape(-1)[by]
    keep = by[np.arange(len(by)) - np.searchsorted(kind, kind) < k]
    x, rows = x[keep], keep
    step, out = max(1, NEAR_CELLS // len(x)), []
    for i in range(0, len(q), step):
        s = q[i : i + step] @ x.T
        hit = s >= (-np.inf if least is None else least - SCREEN)
        if s.shape[1] > k:
            hit &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 2 * SCREEN
        r, c = np.nonzero(hit)
        sim = (q[i + r] * x[c]).sum(1)  # the same bits for equal vectors
        order = np.lexsort((ids[rows[c]], -sim.round(9), r))
        r, c, sim = r[order], c[order], sim[order]
        ok = np.arange(len(r)) - np.searchsorted(r, r) < k
        if least is not None:
            ok &= sim >= least
        out.append((i + r[ok], rows[c[ok]], sim[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _knn_block(vectors: DataFrame, block: pd.DataFrame, k: int, least: float | None) -> DataFrame:
    spark = vectors.sparkSession
    groups = []
    for width, own in block.groupby(block["vec"].map(len)):
        if width:
            groups.append((int(width), own["query_id"].to_numpy(), _unit(np.array(own["vec"].tolist(), np.float64))))
    shared = spark.sparkContext.broadcast(groups)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_width = {width: (names, q) for width, names, q in shared.value}
        held: dict[int, pd.DataFrame] = {}
        for pdf in frames:
            size = pdf["vec"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            for width, (_, q) in by_width.items():
                own = pdf[size == width]
                if not len(own):
                    continue
                ids = own["id"].to_numpy()
                r, c, sim = _best_of(q, _unit(np.array(own["vec"].tolist(), np.float64)), ids, k, least)
                new = pd.DataFrame({"query": r, "id": ids[c], "sim": sim})
                if width in held:
                    new = pd.concat([held[width], new])
                    new = new.assign(by=-new["sim"].round(9)).sort_values(["query", "by", "id"]).drop(columns="by")
                    new = new[new.groupby("query").cumcount() < k]
                held[width] = new
        for width, best in held.items():
            yield pd.DataFrame({"query_id": by_width[width][0][best["query"]], "id": best["id"].to_numpy(), "sim": best["sim"].to_numpy()})

    return vectors.select(F.col("id").cast("string").alias("id"), "vec").mapInPandas(run, "query_id string, id string, sim double")


def all_near(rows: DataFrame, queries: DataFrame, columns: tuple[str, ...], least: float, strict: bool = False) -> DataFrame:
    """(query_id, id, sim): every row whose cosine to the query is at least ``least`` (above it if ``strict``) in all ``columns``.

    ``rows`` (id, columns) and ``queries`` (query_id, columns) hold float arrays; sim is the least of the cosines. Hits are not cut,
    the row itself is one if it is among the queries. Vectors are treated as in :func:`knn`, queries broadcast in blocks too.
    """
    sizes = [F.coalesce(F.max(F.size(c)), F.lit(0)) for c in columns]
    total, *widths = queries.agg(F.count("*"), *sizes).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id string, id string, sim double")
    parts = -(-total * sum(8 * max(w, 1) + 64 for w in widths) // QUERY_BYTES)
    out: DataFrame | None = None
    for part in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        hits = _near_block(rows, block.select(F.col("query_id").cast("string"), *columns).dropna().toPandas(), columns, least, strict)
        out = hits if out is None else out.unionByName(hits)
    return out


def _near_block(rows: DataFrame, block: pd.DataFrame, columns: tuple[str, ...], least: float, strict: bool) -> DataFrame:
    units = lambda pdf: [_unit(np.array(pdf[c].tolist(), np.float64)) for c in columns]
    width = lambda pdf: pd.Series(list(zip(*[pdf[c].map(len) for c in columns])), pdf.index, dtype=object)
    groups = [(key, own["query_id"].to_numpy(), units(own)) for key, own in block.groupby(width(block)) if all(key)]
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes = width(pdf)
            for key, names, q in shared.value:
                own = pdf[sizes == key]
                if not len(own):
                    continue
                x, ids = units(own), own["id"].to_numpy()
                step = max(1, NEAR_CELLS // len(own))
                for i in range(0, len(names), step):
                    s = np.minimum.reduce([a[i : i + step] @ b.T for a, b in zip(q, x)])
                    r, c = np.nonzero(s > least if strict else s >= least)
                    yield pd.DataFrame({"query_id": names[i + r], "id": ids[c], "sim": s[r, c]})

    return rows.select(F.col("id").cast("string").alias("id"), *columns).dropna().mapInPandas(run, "query_id string, id string, sim double")


def nearest_in_all(rows: DataFrame, queries: DataFrame, columns: tuple[str, ...], threshold: float) -> DataFrame:
    """(query_id, id, sim): the other row above ``threshold`` in all ``columns`` with the best least similarity; ties to the smaller id."""
    others = all_near(rows, queries, columns, threshold, strict=True).where("query_id <> id")
    best = F.min(F.struct((-F.round("sim", 9)).alias("by"), "id", "sim"))
    return others.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.id", "b.sim")


#: Pairs of which a task sums the cosines exactly at once.
EXACT_PAIRS = 1 << 15


def best_in_all(rows: DataFrame, queries: DataFrame, columns: tuple[str, ...], threshold: float) -> DataFrame:
    """(query_id, id, sim): the row above ``threshold`` in all ``columns`` with the best least cosine, to nine digits; ties to the smaller id.

    Every row is compared with every query and no hit is cut, but none is written either: a task keeps the best row of each query only.
    Vectors are treated as in :func:`all_near`, those with a number that is not finite are skipped; queries are broadcast in blocks.
    """
    sizes = [F.coalesce(F.max(F.size(c)), F.lit(0)) for c in columns]
    total, *widths = queries.agg(F.count("*"), *sizes).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id string, id string, sim double")
    parts = -(-total * sum(8 * max(w, 1) + 64 for w in widths) // QUERY_BYTES)
    out: DataFrame | None = None
    for part in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        hits = _best_block(rows, block.select(F.col("query_id").cast("string"), *columns).dropna().toPandas(), columns, threshold)
        out = hits if out is None else out.unionByName(hits)
    best = F.min(F.struct((-F.round("sim", 9)).alias("by"), "id", "sim"))
    return out.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.id", "b.sim")


def _units_by_width(pdf: pd.DataFrame, name: str, columns: tuple[str, ...]) -> dict[tuple[int, ...], tuple[np.ndarray, list[np.ndarray]]]:
    """``name`` and unit rows of each column of the rows by the widths of their vectors; empty and not finite vectors are left out."""
    width = pd.Series(list(zip(*[pdf[c].map(len) for c in columns])), pdf.index, dtype=object)
    out = {}
    for key, own in pdf.groupby(width):
        if all(key):
            x = [_unit(np.array(own[c].tolist(), np.float64)) for c in columns]
            ok = np.logical_and.reduce([np.isfinite(a).all(1) for a in x])
            out[key] = (own[name].to_numpy()[ok], [a[ok] for a in x])
    return out


def _best_block(rows: DataFrame, block: pd.DataFrame, columns: tuple[str, ...], threshold: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_units_by_width(block, "query_id", columns))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {key: (q, [a.astype(np.float32) for a in q]) for key, (_, q) in shared.value.items()}
        held = {key: (np.full(len(names), -np.inf), np.full(len(names), "", object)) for key, (names, _) in shared.value.items()}
        for pdf in frames:
            for key, (ids, x) in _units_by_width(pdf, "id", columns).items():
                if key not in asked or not len(ids):
                    continue
                # of equal rows the smallest id stands for all
                by = np.argsort(ids, kind="stable")
                by = by[~pd.Series([row.tobytes() for row in np.concatenate(x, axis=1)[by]]).duplicated().to_numpy()]
                ids, x = ids[by], [a[by] for a in x]
                _keep_best(*asked[key], ids, x, [np.ascontiguousarray(a.T, np.float32) for a in x], threshold, *held[key])
        for key, (sim, ids) in held.items():
            hit = np.isfinite(sim)
            yield pd.DataFrame({"query_id": shared.value[key][0][hit], "id": ids[hit], "sim": sim[hit]})

    return rows.select(F.col("id").cast("string").alias("id"), *columns).dropna().mapInPandas(run, "query_id string, id string, sim double")


def _keep_best(q: list[np.ndarray], q4: list[np.ndarray], ids: np.ndarray, x: list[np.ndarray], x4: list[np.ndarray], threshold: float, sim: np.ndarray, best: np.ndarray) -> None:
    """Put the best of the rows ``x``, in order of ``ids``, into ``sim`` and ``best`` of each query where it beats what is there.

    A product in single precision leaves the rows that may be the best or tie with it; their cosines are summed row by row.
    """
    slack = (max(a.shape[1] for a in x) + 8) * 1.2e-7  # of sums of unit vectors in single precision, twice and then some
    step = max(1, NEAR_CELLS // len(ids))
    for i in range(0, len(sim), step):
        s = q4[0][i : i + step] @ x4[0]
        for a, b in zip(q4[1:], x4[1:]):
            np.minimum(s, a[i : i + step] @ b, out=s)
        least = np.maximum(np.maximum(threshold, sim[i : i + step] - SCREEN), s.max(1) - slack - SCREEN) - slack
        r, c = np.nonzero(s >= least.astype(np.float32)[:, None])
        if not len(r):
            continue
        exact = np.concatenate([np.minimum.reduce([(a[i + m] * b[n]).sum(1) for a, b in zip(q, x)]) for m, n in zip(*[np.array_split(v, -(-len(r) // EXACT_PAIRS)) for v in (r, c)])])
        near = exact > threshold
        r, c, exact = r[near], c[near], exact[near]
        by = np.lexsort((c, -exact.round(9), r))
        by = by[np.diff(r[by], prepend=-1) > 0]
        r, c, exact = i + r[by], c[by], exact[by]
        new, old = exact.round(9), sim[r].round(9)
        better = (new > old) | ((new == old) & (ids[c] < best[r]))
        sim[r[better]], best[r[better]] = exact[better], ids[c[better]]


def vector_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(class, id) and (a, b, sim) of :func:`all_near` classes a <= b: rows of equal vectors are one class, named by its smallest id."""
    own = vectors.select(F.col("id").cast("string").alias("id"), "vec").where("vec is not null")
    kinds = cut(own.groupBy("vec").agg(F.min("id").alias("class")))
    near = all_near(kinds.select(F.col("class").alias("id"), "vec"), kinds.select(F.col("class").alias("query_id"), "vec"), ("vec",), least)
    links = near.where("query_id <= id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "sim")
    return cut(own.join(kinds, "vec").select("class", "id")), cut(links)


def near_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, sim), a < b: all pairs of rows (id, vec) of cosine at least ``least``."""
    members, links = vector_classes(vectors, least)
    both = links.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b")
    return both.where("a < b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def near_links(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the same rows, directly or through others, as :func:`near_pairs`, without the pairs within a class."""
    members, links = vector_classes(vectors, least)
    alike = links.where("a = b").select(F.col("a").alias("class")).join(members, "class").where("class <> id")
    return links.where("a < b").select("a", "b").unionByName(alike.select(F.col("class").alias("a"), F.col("id").alias("b")))


def three_field(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim, pos): best ``k`` rows by the best of their fields, over ``vectors`` (field, id, vec) in one pass.

    The best of each field merged by their best similarity and cut to ``k`` are these.
    """
    return knn(vectors.select("id", "vec"), queries, k, per_id=len(TEXT_COLUMNS))


def near_duplicate(hits: list[DataFrame], threshold: float = 0.95) -> DataFrame:
    """(query_id, id, sim): the row above ``threshold`` in all fields with the best least similarity; ties to the smaller id."""
    both = hits[0].where(F.col("sim") > threshold)
    for h in hits[1:]:
        both = both.unionByName(h.where(F.col("sim") > threshold))
    all_ = both.groupBy("query_id", "id").agg(F.count("*").alias("fields"), F.min("sim").alias("sim")).where(F.col("fields") == len(hits))
    return top(all_, 1, [F.col("sim").desc()]).select("query_id", "id", "sim")


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall: mean share of the true best ``k`` that were found, over the queries of ``truth``."""
    hits = truth.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("r")).agg(F.avg("r").alias("recall"))


# -- fusion

def rrf(vector: DataFrame, text: DataFrame, k: float = RRF_K, w_vector: float = W_VECTOR, w_text: float = W_TEXT) -> DataFrame:
    """(query_id, id, score, place): weighted reciprocal rank fusion of two ranked lists (query_id, id, pos)."""
    part = lambda df, w: df.select("query_id", "id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("pos"))).alias("s"))
    fused = part(vector, w_vector).unionByName(part(text, w_text)).groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
    return fused.withColumn("place", F.row_number().over(order))


def shadow_rewards(fused: DataFrame, ks: tuple[int, ...] = SHADOW_K) -> DataFrame:
    """(query_id, k, reward): share of a query's score its first k hits hold; none where the total is not positive."""
    sums = fused.groupBy("query_id").agg(F.sum("score").alias("total"), *[F.sum(F.when(F.col("place") <= k, F.col("score"))).alias(f"s{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / F.col("total")).alias("reward")) for k in ks])).alias("r")
    return sums.where("total > 0").select("query_id", each).select("query_id", "r.k", "r.reward")


def rewards_json(rewards: DataFrame) -> DataFrame:
    """(query_id, shadow_rewards): rewards as JSON text, by ascending k."""
    return rewards.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "reward")))).alias("shadow_rewards"))


# -- hybrid search

def search(
    memories: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None,
    limit: int = 10,
    tags: list[str] | None = None,
    stem: bool = True,
    k: float = RRF_K,
    w_vector: float = W_VECTOR,
    w_text: float = W_TEXT,
    index: TextIndex | None = None,
) -> DataFrame:
    """Hybrid hits of each query (query_id, query[, vec]): query_id, place, id, rrf, the row's shown columns, and degraded.

    ``vectors`` (field, id, vec) are the searchable vectors; a query without a vector, or a search without vectors, is degraded to its text
    leg and says so. ``index`` is a kept text index of the memories. As in the store searched, superseded rows and rows without all ``tags``
    drop out after the cut to ``limit``.
    """
    index = index or TextIndex.build(memories, stem)
    text = bm25(index, query_tokens(queries, index.stem), limit).select("query_id", "id", "pos")
    if vectors is None:
        near, degraded = text.limit(0), queries.select("query_id", F.lit(True).alias("degraded"))
    else:
        near = three_field(vectors, queries.select("query_id", "vec"), limit).select("query_id", "id", "pos")
        degraded = queries.select("query_id", F.col("vec").isNull().alias("degraded"))
    fused = rrf(near, text, k, w_vector, w_text).where(F.col("place") <= limit).withColumnRenamed("score", "rrf")
    shown = memories.where("superseded_by is null").where(has_tags(F.col("tags"), tags or []))
    hits = small(cut(fused)).join(shown, "id").select("query_id", "place", "id", "rrf", "score", "context", "action", "result", "memory_type", "tags")
    return hits.join(degraded, "query_id")


HIT = ("id", "score", "context", "action", "result", "memory_type", "tags")


def envelope(hits: DataFrame, queries: DataFrame, degraded: Column) -> DataFrame:
    """(query_id, response) with the JSON text {"results": [...], "degraded": ...}, hits in their order; a query without hits has none.

    ``degraded`` is a column of ``queries``. A query's hits are at most the limit of its search.
    """
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*HIT).alias("hit")))).alias("rows"))
    listed = F.coalesce(F.transform("rows", lambda r: r["hit"]), F.array())
    return queries.select("query_id", degraded.alias("degraded")).join(own, "query_id", "left").select("query_id", F.to_json(F.struct(listed.alias("results"), "degraded")).alias("response"))


def diverse(candidates: DataFrame, vectors: DataFrame, m: int, backfill: bool = True) -> DataFrame:
    """(query_id, id, sim, pos): at most ``m`` of each query's candidates (query_id, id, sim), spread out.

    From the most similar on, a candidate is taken unless it is nearer to one taken before than to the query; with ``backfill``
    the best of the others fill up. Ties go to the smaller id, a candidate without a vector is taken. ``vectors`` (id, vec) hold the candidates' vectors; a query's candidates are
    a search's hits, so they fit a task.
    """
    rows = candidates.select("query_id", "id", "sim").join(vectors.select("id", "vec"), "id", "left")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(by=-pdf["sim"].round(9)).sort_values(["by", "id"])
        x = [None if v is None else _unit(np.array([v], np.float64))[0] for v in pdf["vec"]]
        sim, taken = pdf["sim"].to_numpy(), []
        for i in range(len(x)):
            if len(taken) < m and not any(x[i] is not None and x[t] is not None and float((x[i] * x[t]).sum()) > sim[i] for t in taken):
                taken.append(i)
        if backfill:
            taken += [i for i in range(len(x)) if i not in taken][: m - len(taken)]
        out = pdf.iloc[taken][["query_id", "id", "sim"]]
        return out.assign(pos=np.arange(1, len(out) + 1, dtype=np.int32))

    return rows.groupBy("query_id").applyInPandas(pick, "query_id string, id string, sim double, pos int")


def percentiles(times: DataFrame, column: str = "ms", ranks: tuple[float, ...] = (0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """One row with the exact percentiles p50, p95, p99, p99_9 of a column: the value at rank ceil(p * n)."""
    names = [f"p{r * 100:g}".replace(".", "_") for r in ranks]
    return times.agg(*[F.expr(f"percentile_disc({r}) within group (order by {column})").alias(n) for r, n in zip(ranks, names)])
