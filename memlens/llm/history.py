"""Deduplicating new batches against all history, by multi-key sorted neighbourhoods.

The history lives in a folder that can be closed and opened again. It is a list of runs; each holds
every record once a key, sorted by the key and range-partitioned into files. A key is the leaf of a small-leaved k-means
tree over one field and, within the leaf, the cosine to its centre. A batch is first compared with narrow windows
around its own records, and only the files whose ranges these touch are read. What they are and how many is learnt from a sample, so
records they don't match are compared again with all that the triangle inequality leaves of the history: the sample
decides how fast a near record is found, never whether. Accepted records become a new sorted run, and small runs are merged when there are too many.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.llm.vectors import BLOCK_ROWS, DIM, FIELDS, Tree, all_above, fit_trees, matrix, usable
from memlens.runtime import cut, drop_table, new_table

#: Fields whose trees give the sort keys, rows a leaf is planned for, rows of a file of a run.
KEYS, LEAF_ROWS, PART_ROWS = (0, 2), 256, 1 << 15
#: Rate at which near pairs of the sample must meet by one key at first, and the margin on the widest window the sample asks for.
RECALL, MARGIN = 0.998, 1.25
#: Rows of a batch that are compared with a stretch of a leaf at once, and what rounding may add to an angle.
STEP, ROUNDING = 256, 5e-3
#: Bytes of one broadcast block of new records; longer batches take several passes.
BLOCK_BYTES = 48 << 20
#: Earlier neighbours listed for a record at once; where all of them fall away the next are asked for.
LISTED = 8
#: Runs beyond which small ones are merged; a run is small under a quarter of the largest.
MOST_RUNS, SMALL = 4, 4
SCREEN = 1e-5
RUN = "key int, leaf int, s float, vec0 binary, vec1 binary, vec2 binary"
SORT = ["key", "leaf", "s", "vec0", "vec1", "vec2"]
BLOBS = [f"embedding_{f}" for f in FIELDS]


def _triples(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.logical_and.reduce([usable(pdf[c]) for c in columns])


def complete(df: DataFrame, order: list[str], blobs: list[str]) -> DataFrame:
    """(at, vec0, vec1, vec2) of the rows with three usable vectors; ``at`` is a struct that sorts by arrival."""
    named = df.select(F.struct(*order).alias("at"), *[F.col(b).alias(f"vec{i}") for i, b in enumerate(blobs)])
    for i in range(len(blobs)):
        named = named.where(F.octet_length(f"vec{i}") == 4 * DIM)
    return named


class Key:
    """One sort key: a tree, how many leaves to look into at first, how wide, and where each leaf lies in the order."""

    def __init__(self, tree: Tree, sample: np.ndarray, least: float):
        self.tree = tree
        pairs = tree.near_sample(sample, least) if len(sample) else None
        # leaves that a new record looks into for a stored one
        self.probes = tree.calibrate(sample, least, RECALL, 2, one_sided=True, pairs=pairs)
        self.window = math.sqrt(2 * (1 - least)) + 1e-3  # cosines to a fixed direction differ by no more between near vectors
        nodes = len(tree.centres)
        share, self.low, self.high = np.where(tree.leaf, 0.5, 0.0), np.full(nodes, -1.0), np.full(nodes, 1.0)
        if len(sample):
            leaf = tree.visit(sample, 1)[:, 0]
            s = (sample * tree.centres[leaf]).sum(1)
            np.add.at(share, leaf, 1)
            for x in np.unique(leaf):
                self.low[x], self.high[x] = s[leaf == x].min(), s[leaf == x].max() + 1e-6
            a, b = pairs
            home = tree.visit(b, 1)[:, 0]
            apart = np.abs(((a - b) * tree.centres[home]).sum(1))
            if len(apart):  # what near pairs need is far less than the bound
                self.window = min(self.window, MARGIN * float(np.quantile(apart, 0.9995)) + 1e-3)
        self.end = np.cumsum(share) / share.sum()
        self.begin = self.end - share / share.sum()

    def place(self, leaf: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Where a row lies in the order of this key, in [0, 1)."""
        within = np.clip((s - self.low[leaf]) / (self.high[leaf] - self.low[leaf]), 0, 1 - 1e-9)
        return np.minimum(self.begin[leaf] + (self.end - self.begin)[leaf] * within, 1 - 1e-9)

    def arrays(self) -> dict[str, np.ndarray]:
        t = self.tree
        return {"centres": t.centres, "kids": t.kids, "leaf": t.leaf, "gain": t.gain, "low": self.low, "high": self.high, "begin": self.begin, "end": self.end, "rest": np.array([self.probes, self.window])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Key:
        self, self_tree = cls.__new__(cls), Tree.__new__(Tree)
        for name in ("centres", "kids", "leaf", "gain"):
            setattr(self_tree, name, arrays[name])
        for name in ("low", "high", "begin", "end"):
            setattr(self, name, arrays[name])
        self.tree, (probes, self.window) = self_tree, arrays["rest"]
        self.probes = int(probes)
        return self


def part_of(keys: dict[int, Key], key: np.ndarray, leaf: np.ndarray, s: np.ndarray, parts: int) -> np.ndarray:
    """The file of a run of ``parts`` files that each row belongs to; files hold contiguous ranges of (key, leaf, s)."""
    out = np.zeros(len(key), np.int32)
    for k, (f, own) in enumerate(keys.items()):
        at = key == f
        out[at] = ((k + own.place(leaf[at], s[at])) * parts / len(keys)).astype(np.int32)
    return out


class History:
    """Accepted records as sorted runs in the folder ``path``. Every row of ``accepted`` is indexed; trees are fitted on a bounded sample.

    Rows with an unusable vector are left out, equal rows are held once. :meth:`open` takes up a history that was written before.
    """

    def __init__(self, accepted: DataFrame, path: str | None = None, blobs: list[str] = BLOBS, least: float = 0.95, id_col: str = "id"):
        self.spark: SparkSession = accepted.sparkSession
        self.path, self.blobs, self.least = path or new_table(self.spark), list(blobs), least
        fitted = fit_trees(accepted, [self.blobs[f] for f in KEYS], LEAF_ROWS, id_col=id_col)
        self.keys: dict[int, Key] = {f: Key(*fitted[self.blobs[f]], least) for f in KEYS}
        self.runs: list[dict] = []
        self.version, self.touched = 0, (0, 0)
        raw = io.BytesIO()
        np.savez(raw, **{f"{f}_{n}": a for f, key in self.keys.items() for n, a in key.arrays().items()})
        self.spark.createDataFrame([(json.dumps({"blobs": self.blobs, "least": least}), bytearray(raw.getvalue()))], "meta string, keys binary").coalesce(1).write.parquet(f"{self.path}/keys")
        self._add(accepted.select(*[F.col(b).alias(f"vec{i}") for i, b in enumerate(self.blobs)]), accepted.count())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history that was last saved in ``path``."""
        self = cls.__new__(cls)
        self.spark, self.path, self.touched = spark, path, (0, 0)
        row = spark.read.parquet(f"{path}/keys").first()
        meta, arrays = json.loads(row["meta"]), np.load(io.BytesIO(bytes(row["keys"])))
        self.blobs, self.least = meta["blobs"], meta["least"]
        self.keys = {f: Key.of({n.split("_", 1)[1]: arrays[n] for n in arrays.files if n.startswith(f"{f}_")}) for f in KEYS}
        self.version = max(int(n.removeprefix("state-")) for n in self._names(path) if n.startswith("state-") and "_SUCCESS" in self._names(f"{path}/{n}"))
        self.runs = [json.loads(r["run"]) for r in spark.read.parquet(f"{path}/state-{self.version}").collect()]
        return self

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)]

    def _save(self) -> None:
        """Write the list of runs as the next version; only then what it no longer names may go."""
        self.version += 1
        self.spark.createDataFrame([(json.dumps(r),) for r in self.runs], "run string").coalesce(1).write.parquet(f"{self.path}/state-{self.version}")
        for n in self._names(self.path):
            old = n.startswith("state-") and int(n.removeprefix("state-")) < self.version
            if old or n.startswith("run-") and n not in {r["name"] for r in self.runs}:
                p, fs = self._fs(f"{self.path}/{n}")
                fs.delete(p, True)

    def _write(self, keyed: DataFrame, rows: int) -> dict:
        """A run of the rows ``keyed`` (RUN), sorted and range-partitioned; equal rows are kept once, in each task before they are moved already."""
        parts, keys = max(1, -(-rows * len(self.keys) // PART_ROWS)), self.keys

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    pdf = pdf.drop_duplicates(SORT)
                    yield pdf.assign(part=part_of(keys, pdf["key"].to_numpy(), pdf["leaf"].to_numpy(), pdf["s"].to_numpy(float), parts))

        def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None
            for pdf in frames:
                if len(pdf):
                    same = (pdf[SORT].shift() == pdf[SORT]).all(axis=1).to_numpy()
                    row = tuple(pdf[SORT].iloc[0])
                    same[0] = row == last
                    last = tuple(pdf[SORT].iloc[-1])
                    yield pdf.loc[~same, SORT]

        name = f"run-{self.version}-{len(self.runs)}"
        dealt = keyed.mapInPandas(deal, f"{RUN}, part int").repartitionById(parts, "part").sortWithinPartitions(*SORT)
        dealt.select(*SORT).mapInPandas(once, RUN).write.parquet(f"{self.path}/{name}")
        files = {n.split("-")[1]: n for n in self._names(f"{self.path}/{name}") if n.startswith("part-")}
        return {"name": name, "parts": parts, "rows": rows, "files": {str(int(k)): n for k, n in files.items()}}

    def _keyed(self, df: DataFrame) -> DataFrame:
        """Each usable row (vec0..) once a key, with its leaf and cosine."""
        keys, columns = self.keys, [f"vec{i}" for i in range(len(self.blobs))]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                pdf = pdf[_triples(pdf, columns)]
                for f, key in keys.items():
                    if len(pdf):
                        x = matrix(pdf[columns[f]])
                        leaf = key.tree.visit(x, 1)[:, 0]
                        yield pd.DataFrame({"key": np.int32(f), "leaf": leaf, "s": (x * key.tree.centres[leaf]).sum(1).astype(np.float32), **{c: pdf[c] for c in columns}})

        for c in columns:
            df = df.where(F.octet_length(c) == 4 * DIM)
        return df.select(*columns).mapInPandas(run, RUN)

    def _add(self, df: DataFrame, rows: int) -> None:
        self.runs.append(self._write(self._keyed(df), rows))
        self._save()

    def _read(self, runs: list[dict]) -> DataFrame:
        files = [f"{self.path}/{r['name']}/{n}" for r in runs for n in r["files"].values()]
        return self.spark.read.schema(RUN).parquet(*files) if files else self.spark.createDataFrame([], RUN)

    def append(self, accepted: DataFrame) -> None:
        """Add accepted records (vec0, vec1, vec2) as a new run."""
        self._add(accepted, accepted.count())

    def compact(self, most: int = MOST_RUNS) -> None:
        """Merge runs until there are no more than ``most``: the small ones where there are several, else all. Sizes so grow by steps, and a record is rewritten a few times in all."""
        while len(self.runs) > max(1, most):
            largest = max(r["rows"] for r in self.runs)
            few = [r for r in self.runs if r["rows"] * SMALL < largest]
            few = few if len(few) > 1 else list(self.runs)
            merged = self._write(self._read(few), sum(r["rows"] for r in few))
            self.runs = [r for r in self.runs if r not in few] + [merged]
            self._save()

    # -- a batch against the runs

    def _asked(self, new: DataFrame) -> DataFrame:
        """``new`` with the leaves each row looks into for every key and its cosines to their centres."""
        keys, columns = self.keys, [f"vec{i}" for i in range(len(self.blobs))]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                pdf = pdf[_triples(pdf, columns)]
                out = {c: pdf[c] for c in ("n", *columns)}
                for f, key in keys.items():
                    x = matrix(pdf[columns[f]]) if len(pdf) else np.zeros((0, DIM))
                    leaves = key.tree.visit(x, key.probes)
                    out[f"leaf{f}"] = list(leaves)
                    out[f"s{f}"] = list(np.einsum("nd,nkd->nk", x, key.tree.centres[leaves]).astype(np.float32))
                yield pd.DataFrame(out)

        fields = ", ".join([*[f"{c} binary" for c in columns], *[f"leaf{f} array<int>, s{f} array<float>" for f in keys]])
        return new.mapInPandas(run, f"n long, {fields}")

    def matched(self, new: DataFrame) -> DataFrame:
        """(n) of the rows of ``new`` (n, vec0..) that are near an accepted record in all fields."""
        width = 4 * DIM * len(self.blobs) + 16 * sum(k.probes for k in self.keys.values())
        parts = max(1, math.ceil(new.count() * width / BLOCK_BYTES))
        found: DataFrame | None = None
        for part in range(parts):
            block = new.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part) if parts > 1 else new
            asked = self._asked(block).toPandas()
            hits = cut(self._probe(asked))
            rest = asked[~asked["n"].isin(hits.distinct().toPandas()["n"])]
            hits = hits.unionByName(self._scan(rest))
            found = hits if found is None else found.unionByName(hits)
        return found.distinct()

    def _touching(self, key: np.ndarray, leaf: np.ndarray, s: np.ndarray, window: np.ndarray) -> list[str]:
        """The files of all runs whose ranges the windows touch."""
        out, every = [], 0
        for r in self.runs:
            lo, hi = (part_of(self.keys, key, leaf, s + side * window, r["parts"]) for side in (-1, 1))
            edges = np.zeros(r["parts"] + 1, np.int64)
            np.add.at(edges, lo, 1)
            np.add.at(edges, hi + 1, -1)
            out += [f"{self.path}/{r['name']}/{n}" for p, n in r["files"].items() if np.cumsum(edges)[int(p)]]
            every += len(r["files"])
        self.touched = (len(out), every)
        return out

    def _probe(self, block: pd.DataFrame) -> DataFrame:
        block = block.reset_index(drop=True)
        none = self.spark.createDataFrame([], "n long")
        if not len(block):
            return none
        ranges: dict[tuple[int, int], np.ndarray] = {}
        asked = []
        for f, key in self.keys.items():
            leaves, cosines = np.stack(block[f"leaf{f}"]), np.stack(block[f"s{f}"]).astype(float)
            row, _ = np.nonzero(leaves >= 0)
            at, s = leaves[leaves >= 0], cosines[leaves >= 0]
            by = np.lexsort((s, at))
            row, at, s = row[by], at[by], s[by]
            asked.append((np.full(len(at), f), at, s, np.full(len(at), key.window)))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1]) if len(at) else []
            for lo, hi in zip(starts, [*starts[1:], len(at)]):
                ranges[f, int(at[lo])] = np.rec.fromarrays([row[lo:hi], s[lo:hi]], names="row,s")
        files = self._touching(*[np.concatenate(c) for c in zip(*asked)])
        if not files:
            return none
        shared = self.spark.sparkContext.broadcast((block["n"].to_numpy(), [b"".join(block[f"vec{i}"]) for i in range(len(self.blobs))], ranges))
        least, windows = self.least, {f: k.window for f, k in self.keys.items()}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, raw, ranges = shared.value
            mine = [matrix([r]) for r in raw]
            fast = [m.astype(np.float32) for m in mine]
            hit = np.zeros(len(n), bool)
            for pdf in frames:
                code = pdf["key"].to_numpy().astype(np.int64) << 32 | pdf["leaf"].to_numpy()
                # a task may read parts of several files one after the other: where the order breaks a new stretch begins
                edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(pdf["s"].to_numpy()) < 0)) + 1), len(code)]
                before = hit.copy()
                for lo, hi in zip(edges, edges[1:]):
                    if hi <= lo or (probe := ranges.get((int(code[lo] >> 32), int(code[lo] & 0xFFFFFFFF)))) is None:
                        continue
                    f = int(code[lo] >> 32)
                    s = pdf["s"].to_numpy()[lo:hi]
                    open_ = probe[~hit[probe.row]]
                    if not len(open_):
                        continue
                    theirs = [matrix(pdf[f"vec{i}"].to_numpy()[lo:hi]) for i in range(len(mine))]
                    lead = theirs[f].astype(np.float32)
                    for i in range(0, len(open_), 64):
                        rows = open_.row[i : i + 64]
                        a, b = np.searchsorted(s, [open_.s[i] - windows[f], open_.s[min(i + 64, len(open_)) - 1] + windows[f]])
                        if a == b:
                            continue
                        r, c = np.nonzero(fast[f][rows] @ lead[a:b].T > least - SCREEN)
                        hit[rows[r[all_above(list(zip(mine, theirs)), rows[r], a + c, least)]]] = True
                new = np.flatnonzero(hit & ~before)
                if len(new):
                    yield pd.DataFrame({"n": n[new]})

        return self.spark.read.schema(RUN).parquet(*files).mapInPandas(run, "n long")

    def _scan(self, block: pd.DataFrame) -> DataFrame:
        """(n) of the rows of a block that are near a stored record, for certain.

        Near vectors differ in their angle to any direction by no more than the angle between them. One key is enough: a row is compared with the
        stretch of each leaf whose angles to the centre are that near to its own.
        """
        if not len(block) or not self.runs:
            return self.spark.createDataFrame([], "n long")
        f, width = KEYS[0], len(self.blobs)
        shared = self.spark.sparkContext.broadcast((block["n"].to_numpy(), [b"".join(block[f"vec{i}"]) for i in range(width)], self.keys[f].tree.centres))
        least, reach = self.least, math.acos(min(1.0, max(-1.0, self.least))) + ROUNDING

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, raw, centres = shared.value
            mine = [matrix([r]) for r in raw]
            fast = mine[f].astype(np.float32)
            hit = np.zeros(len(n), bool)
            for pdf in frames:
                leaf, s = pdf["leaf"].to_numpy(), pdf["s"].to_numpy()
                edges = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (np.diff(s) < 0)) + 1), len(pdf)]
                blobs = [pdf[f"vec{i}"].to_numpy() for i in range(width)]
                before, lead = hit.copy(), matrix(blobs[f]).astype(np.float32) if len(pdf) else None
                for lo, hi in zip(edges, edges[1:]):
                    if hi <= lo:
                        continue
                    own = s[lo:hi]
                    angle = np.arccos(np.clip(fast @ centres[leaf[lo]], -1, 1))
                    low, high = np.cos(np.minimum(angle + reach, np.pi)), np.cos(np.maximum(angle - reach, 0))
                    # cosines next to 1 and -1 are rounded too
                    low, high = np.where(angle + reach >= np.pi, -2, low), np.where(angle <= reach, 2, high)
                    open_ = np.flatnonzero(~hit & (high >= own[0]) & (low <= own[-1]))
                    open_ = open_[np.argsort(angle[open_])]
                    for i in range(0, len(open_), STEP):
                        rows = open_[i : i + STEP]
                        a, b = np.searchsorted(own, low[rows[-1]]), np.searchsorted(own, high[rows[0]], side="right")
                        r, c = np.nonzero(fast[rows] @ lead[lo + a : lo + b].T > least - SCREEN)
                        if len(r):
                            kinds, at = np.unique(c, return_inverse=True)
                            theirs = [matrix(v[lo + a + kinds]) for v in blobs]
                            hit[rows[r[all_above(list(zip(mine, theirs)), rows[r], at, least)]]] = True
                new = np.flatnonzero(hit & ~before)
                if len(new):
                    yield pd.DataFrame({"n": n[new]})

        return self._read(self.runs).where(F.col("key") == f).mapInPandas(run, "n long")

    # -- a batch against itself

    def _neighbours(self, rows: DataFrame, after: DataFrame | None) -> DataFrame:
        """(n, near, more): the first earlier neighbours of each row, beyond ``after`` (n, seen) if given.

        All rows are compared, in pairs of blocks of BLOCK_ROWS, each a group of its own.
        """
        least, columns = self.least, [f"vec{i}" for i in range(len(self.blobs))]
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                own = np.repeat(pdf["n"].to_numpy() % blocks, blocks)
                other = np.tile(np.arange(blocks), len(pdf))
                row = np.repeat(np.arange(len(pdf)), blocks)
                yield pd.DataFrame({"i": np.minimum(own, other).astype(np.int32), "j": np.maximum(own, other).astype(np.int32), **{c: pdf[c].to_numpy()[row] for c in pdf.columns}})

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("n")
            n = pdf["n"].to_numpy()
            x = [matrix(pdf[c]) for c in columns]
            lead, out = x[KEYS[0]].astype(np.float32), []
            seen = pdf["seen"].to_numpy() if "seen" in pdf else np.full(len(n), -1)
            for i in range(0, len(n), 128):
                r, c = np.nonzero(np.tril(lead[i : i + 128] @ lead[: i + 128].T > least - SCREEN, i - 1))
                r = r + i
                later = n[c] > seen[r]
                r, c = r[later], c[later]
                ok = all_above([(g, g) for g in x], r, c, least)
                r, c = r[ok], c[ok]
                if len(r):
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    out.append(pd.DataFrame({"n": n[r], "near": n[c], "last": rank == LISTED})[rank <= LISTED])
            return pd.concat(out) if out else pd.DataFrame({"n": [], "near": [], "last": []}).astype({"n": "int64", "near": "int64", "last": bool})

        src = rows if after is None else rows.join(after, "n", "left").withColumn("seen", F.coalesce("seen", F.lit(2**62)))
        fields = ", ".join(f"{c} binary" for c in columns) + (", seen long" if after is not None else "")
        at = src.mapInPandas(placed, f"i int, j int, n long, {fields}")
        pairs = at.groupBy("i", "j").applyInPandas(block, "n long, near long, last boolean")
        return cut(pairs.groupBy("n", "near").agg(F.max("last").alias("last")))

    def _accept(self, rows: DataFrame) -> DataFrame:
        """(n, case) for rows that no history matched, decided in the order of ``n``.

        A row is a case if an earlier accepted row is near. Only the first LISTED earlier
        neighbours in a block are listed; a row all of whose neighbours became cases asks for the next.
        """
        edges = self._neighbours(rows, None)
        state = cut(rows.select("n").join(edges.select("n").distinct().withColumn("open", F.lit(True)), "n", "left").select("n", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(False).alias("case")))
        while not state.where("case is null").isEmpty():
            open_ = state.where("case is null").select("n")
            # neighbours after a listing's end may be missing, so they can prove a case but not its absence
            told = edges.join(open_, "n").join(state.withColumnRenamed("n", "near"), "near").groupBy("n").agg(
                F.max(F.when(F.col("case"), 0).when(F.col("case").isNull(), 1).otherwise(2)).alias("worst"),
                F.max("last").alias("last"),
                F.max("near").alias("far"),
                F.min(F.when(F.col("last"), F.col("near"))).alias("end"),
            )
            decided = cut(told.select("n", F.when(F.col("worst") == 2, True).when((F.col("worst") == 0) & ~F.col("last"), False).alias("now"), "worst", "last", "end"))
            stuck = decided.where("worst = 0 and last").select("n", F.col("end").alias("seen"))
            new = cut(state.join(decided.select("n", "now"), "n", "left").select("n", F.coalesce("case", "now").alias("case")))
            drop_table(state)
            state = new
            if not stuck.isEmpty():
                kept = edges.join(stuck.select("n"), "n", "left_anti")
                edges = cut(kept.unionByName(self._neighbours(rows, stuck)))
                asked = stuck.join(edges.select("n").distinct(), "n", "left_anti").withColumn("now", F.lit(False)).select("n", "now")
                new = cut(state.join(asked, "n", "left").select("n", F.coalesce("case", "now").alias("case")))
                drop_table(state)
                state = new
        return state

    def absorb(self, batch: DataFrame, order: list[str], keep: bool = True) -> DataFrame:
        """``order`` columns of the cases of a batch (or several), decided in that order.

        A row is a case if its cosine to one accepted record is above the threshold in all
        fields; accepted are the history and earlier rows of the batch that are no cases.
        Rows without usable vectors are neither. ``order`` must be unique. With ``keep`` the accepted
        rows join the history as a new run. Absorbing batches one by one or together gives the same cases.
        """
        columns = [f"vec{i}" for i in range(len(self.blobs))]

        def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf[_triples(pdf, columns)]

        rows = complete(batch, order, self.blobs)
        flat = rows.select(*[F.col("at")[c].alias(f"o{i}") for i, c in enumerate(order)], *columns)
        flat = flat.mapInPandas(clean, flat.schema)
        # arrival numbers: ranges sorted by arrival, so no task holds the whole batch
        ranked = cut(flat.sort(*[f"o{i}" for i in range(len(order))]).withColumn("n", F.monotonically_increasing_id()))
        same = ranked.select("n", F.xxhash64(*columns).alias("h"), F.md5(F.concat(*columns)).alias("m"))
        first = same.groupBy("h", "m").agg(F.min("n").alias("n"))
        lead = cut(ranked.join(first.select("n"), "n", "left_semi").select("n", *columns))
        copies = ranked.select("n").join(first.select("n"), "n", "left_anti")
        hits = cut(self.matched(lead))
        rest = lead.join(hits, "n", "left_anti")
        state = self._accept(rest)
        if keep:
            self.append(lead.join(state.where("not case"), "n", "left_semi").select(*columns))
            self.compact()
        cases = hits.unionByName(copies).unionByName(state.where("case").select("n"))
        return ranked.join(cases, "n", "left_semi").select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(order)])
