"""Near-duplicate records with small edits, by a Chosen Path set similarity join.

A record is the set of its (word, occurrence) tokens. In each of several
independent trees a node passes a record on to children named by those of its
tokens that hash under a bar; the bar weighs a token by its information, so
paths through frequent tokens don't linger. Nodes that are small enough are
compared exhaustively, larger ones branch again. Pairs that pass a 1-bit minwise
sketch are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.runtime import cut

WORD = regex.compile(r"[\p{L}\p{Nd}]+")
#: Independent trees of one go; expected children of a record in a node are 1 / CHILDREN_SHARE.
TREES, CHILDREN_SHARE = 6, 0.65
#: Share of the pairs that the trees have to find by their own estimate, else as many trees more are grown, and goes at most.
RECALL, GOES = 0.998, 4
#: Standard deviations by which the sketch of a pair at the threshold may be off before it is screened out.
SIGMAS = 4.0
#: Rows of a block of a class of equal records.
CLASS_ROWS = 1024
#: Largest node compared at once, most rounds before large nodes are compared in blocks, tokens chosen in a round, rows of a block.
NODE_ROWS, LEVELS, PATH, BLOCK_ROWS = 256, 4, 4, 4096
#: Tokens in more than one in HEAVY_SHARE sets are counted exactly, others taken for LIGHT; bits of the map of repeated tokens.
HEAVY_SHARE, LIGHT, BITMAP = 2000, 16, 1 << 24
BITS = 128
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tokens_of(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit tokens of (word, occurrence), ascending."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen[w] = seen.get(w, 0) + 1
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append((h + (k - 1) * 0x9E3779B97F4A7C15) & _M)
    return np.sort(np.array(out, np.uint64))


def sketch(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Packed 1-bit minwise sketches of the non-empty sets that begin at ``starts``."""
    bits = np.empty((len(starts), BITS), np.uint8)
    for i, a in enumerate(_FACTORS):
        bits[:, i] = (np.minimum.reduceat(mix(tokens * a) if i == 0 else tokens * a, starts) >> np.uint64(20)) & np.uint64(1)
    return np.packbits(bits, axis=1)


def prepare(df: DataFrame, columns: list[str], min_words: int, id_col: str = "id") -> DataFrame:
    """(id, kind, n, tokens): the token set of each record of at least ``min_words``; ``kind`` names equal sets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in frames:
            ids, kinds, sizes, sets = [], [], [], []
            for row in pdf.itertuples(index=False):
                words = WORD.findall(" ".join(t for t in row[1:] if t is not None).lower())
                if len(words) >= min_words:
                    t = tokens_of(words, cache)
                    ids.append(row[0])
                    kinds.append(xxhash.xxh3_128_digest(t.tobytes()))
                    sizes.append(len(t))
                    sets.append(t.view(np.int64))
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "kind": pd.Series(kinds, dtype=object), "n": np.array(sizes, np.int32), "tokens": pd.Series(sets, dtype=object)})

    return df.select(F.col(id_col).cast("string").alias("id"), *columns).where("id is not null").mapInPandas(run, "id string, kind binary, n int, tokens array<bigint>")


def _flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(list(sets)).astype(np.int64).view(np.uint64) if len(sets) else np.zeros(0, np.uint64)), size


class Frequencies:
    """What is known of token frequencies: the heavy tokens' counts and a bitmap of tokens that occur in more than one set.

    Both are bounded at every size: at most HEAVY_SHARE * (mean set size) heavy tokens, and BITMAP bits. A full bitmap
    only makes some useless choices, it loses nothing.
    """

    def __init__(self, total: int, heavy: np.ndarray, count: np.ndarray, bitmap: np.ndarray):
        by = np.argsort(heavy)
        self.total, self.heavy, self.count, self.bitmap = max(1, total), heavy[by], count[by].astype(float), bitmap

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated sets with each token, and its weight: its information, 0 if it is in one set only."""
        df = np.full(len(tokens), float(LIGHT))
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, tokens), len(self.heavy) - 1)
            hit = self.heavy[at] == tokens
            df[hit] = self.count[at[hit]]
        place = (tokens & np.uint64(BITMAP - 1)).astype(np.int64)
        repeated = (self.bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        return df, np.where(repeated == 1, np.maximum(np.log(self.total / df), 0.05), 0.0)


def frequencies(sets: DataFrame) -> Frequencies:
    count = cut(sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1"))
    total = sets.count()
    heavy = count.where(F.col("count") > max(NODE_ROWS, total // HEAVY_SHARE)).toPandas()
    place = F.col("token").bitwiseAND(BITMAP - 1) + 1  # the bitmap functions number positions from 1
    bits = count.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for b, raw in bits.toPandas().itertuples(index=False):
        part = np.frombuffer(raw, np.uint8)
        bitmap[(b - 1) * len(part) : b * len(part)] |= part
    return Frequencies(total, heavy["token"].to_numpy().astype(np.int64).view(np.uint64), heavy["count"].to_numpy(), bitmap)


def _shared_weight(weight: np.ndarray, size: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """What a partner of equal size and similarity ``least`` shares of each set's weight if it lacks the heaviest tokens, over what it shares of the tokens."""
    lacking = (1 - least) / (1 + least)
    of = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((-weight, of))
    alone = np.add.reduceat((weight == 0).astype(np.int64), start) if len(size) else size  # no partner has these
    heavy = np.arange(len(by)) - start[of] < (np.floor(lacking * size) - alone)[of]
    whole, lost = (np.add.reduceat(w, start) if len(size) else np.zeros(0) for w in (weight, np.where(heavy, weight[by], 0.0)))
    return np.minimum(1 - np.divide(lost, whole, out=np.zeros(len(size)), where=whole > 0), 1 - lacking) / (1 - lacking)


def grow(tokens: np.ndarray, size: np.ndarray, known: Frequencies, record: np.ndarray, node: np.ndarray, expected: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Branch sets from nodes until the nodes are expected to be small: (record, child) rows.

    A node passes a set on to the children of those tokens not on its path that hash under their share of the
    set's weight, so that frequent tokens, which split little, are chosen less. A set whose weight lies in few tokens gets
    more children, as a partner may lack just these.
    """
    df, weight = known.of(tokens)
    start = np.cumsum(size) - size
    share = CHILDREN_SHARE * _shared_weight(weight, size, start, least)
    used: list[np.ndarray] = []
    out_record, out_node = [], []
    for depth in range(PATH):
        lens = size[record]
        begin = np.cumsum(lens) - lens
        branch = np.repeat(np.arange(len(record)), lens)
        at = np.arange(len(branch)) - begin[branch] + start[record][branch]
        w, t = weight[at], tokens[at]
        for u in used:
            w = np.where(t == u[branch], 0.0, w)
        whole = np.add.reduceat(w, begin) if len(begin) else np.zeros(0)
        h = mix(t ^ mix(node[branch]))
        pick = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (share[record] * whole)[branch] < w
        source = branch[pick]
        child = mix(h[pick] + np.uint64(1)) & ~np.uint64(1) | node[source] & np.uint64(1)  # the half of the trees stays in the name
        size_now = expected[source] * df[at[pick]] / known.total
        done = (size_now <= NODE_ROWS / 2) | (depth == PATH - 1)
        out_record.append(record[source[done]])
        out_node.append(child[done])
        used = [u[source[~done]] for u in used] + [t[pick][~done]]
        record, node, expected = record[source[~done]], child[~done], size_now[~done]
        if not len(record):
            break
    return np.concatenate(out_record), np.concatenate(out_node).view(np.int64)


def _pairs(node: np.ndarray, cid: np.ndarray, n: np.ndarray, sk: np.ndarray, least: float, differing: int) -> np.ndarray:
    """Rows (smaller, larger, half) of pairs of equal node (sorted, then by n) that the sizes and sketches allow, each once."""
    at, d, out = np.arange(len(node)), 1, [np.zeros((0, 3), np.int64)]
    while len(at := at[at + d < len(node)]):
        at = at[node[at] == node[at + d]]
        at = at[n[at] >= least * n[at + d]]  # sizes ascend, so a farther partner can't fit either
        if not len(at):
            break
        hit = at[np.bitwise_count(sk[at] ^ sk[at + d]).sum(1) <= differing]
        out.append(np.stack([np.minimum(cid[hit], cid[hit + d]), np.maximum(cid[hit], cid[hit + d]), 1 + (node[hit] & 1)], 1))
        d += 1
    return np.unique(np.concatenate(out), axis=0)


def _words64(sk: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sk), np.uint64).reshape(-1, BITS // 64)


def similar_pairs(sets: DataFrame, least: float, recall: float = RECALL, sigmas: float = SIGMAS) -> DataFrame:
    """(a, b) with a < b of ``sets`` (cid, n, tokens), distinct sets, whose Jaccard similarity reaches ``least``.

    Trees are grown in goes until they have found the share ``recall`` of all pairs by their own estimate: of the pairs that one half of
    the trees finds, the share that the other half finds too tells what either half misses, and both together miss the product.
    """
    share = (1 - least) / 2
    differing = int(BITS * share + sigmas * (BITS * share * (1 - share)) ** 0.5)
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets))
    found: DataFrame | None = None
    for go in range(GOES):
        pairs = _verified(sets, _candidates(sets, least, differing, shared, go), least)
        found = cut(pairs if found is None else found.unionByName(pairs).groupBy("a", "b").agg(F.bit_or("halves").alias("halves")))
        one, two, both = found.agg(*[F.count_if(F.expr(c)) for c in ("halves & 1 > 0", "halves & 2 > 0", "halves = 3")]).first()
        if not one or not two or (1 - both / one) * (1 - both / two) <= 1 - recall:
            break
    return found.select("a", "b")


def _verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, halves) of the candidates whose exact similarity reaches ``least``."""
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")).join(pairs, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "halves", "na", "nb", common.alias("common")).where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= least).select("a", "b", "halves")


def _candidates(sets: DataFrame, least: float, differing: int, shared, go: int) -> DataFrame:
    """(a, b, halves): pairs that share a small node and pass the sketches; ``halves`` has bit 0 for trees of one half and bit 1 for the other.

    Which half a node belongs to is the lowest bit of its name.
    """

    def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            tokens, size = _flat(pdf["tokens"])
            sk = [r.tobytes() for r in sketch(tokens, np.cumsum(size) - size)]
            every = np.tile(np.arange(len(pdf)), TREES)
            number = np.repeat(np.arange(1, TREES + 1, dtype=np.uint64), len(pdf))
            row, child = grow(tokens, size, shared.value, every, (number + np.uint64(TREES * go)) << np.uint64(1) | (number & np.uint64(1)), np.full(len(every), float(shared.value.total)), least)
            yield pd.DataFrame({"node": child, "cid": pdf["cid"].to_numpy()[row], "n": pdf["n"].to_numpy()[row], "sk": np.array(sk, object)[row]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs (node null, n the half) of small nodes; members (b null) of large ones. Rows come sorted by node and n."""
        carry: pd.DataFrame | None = None
        large = None

        def members(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": pdf["node"].astype("Int64"), "a": pdf["cid"], "b": pd.array([None] * len(pdf), "Int64"), "n": pdf["n"].astype("Int32"), "sk": pdf["sk"]})

        def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            node = pdf["node"].to_numpy()
            _, number, count = np.unique(node, return_inverse=True, return_counts=True)
            big = count[number] > NODE_ROWS
            if big.any():
                yield members(pdf[big])
            own = pdf[~big & (count[number] > 1)]
            found = _pairs(own["node"].to_numpy(), own["cid"].to_numpy(), own["n"].to_numpy(), _words64(own["sk"]), least, differing)
            if len(found):
                empty = [None] * len(found)
                yield pd.DataFrame({"node": pd.array(empty, "Int64"), "a": found[:, 0], "b": pd.array(found[:, 1], "Int64"), "n": pd.array(found[:, 2], "Int32"), "sk": pd.Series(empty, dtype=object)})

        for pdf in frames:
            if large is not None:
                same = pdf["node"].to_numpy() == large
                if same.any():
                    yield members(pdf[same])
                pdf = pdf[~same]
                if len(pdf):
                    large = None
            if carry is not None:
                pdf = pd.concat([carry, pdf])
            if not len(pdf):
                continue
            last = pdf["node"].to_numpy() == pdf["node"].iloc[-1]
            if last.sum() > NODE_ROWS:
                large, carry = pdf["node"].iloc[-1], None
                yield members(pdf[last])
            else:
                carry = pdf[last]
            if not last.all():
                yield from work(pdf[~last])
        if carry is not None and len(carry):
            yield from work(carry)

    def branch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            times = np.fromiter(map(len, pdf["nodes"]), np.int64, len(pdf))
            tokens, size = _flat(pdf["tokens"])
            nodes = np.concatenate(list(pdf["nodes"])).astype(np.int64).view(np.uint64)
            at, child = grow(tokens, size, shared.value, np.repeat(np.arange(len(pdf)), times), nodes, np.full(len(nodes), 8.0 * NODE_ROWS), least)
            yield pd.DataFrame({"node": child, "cid": pdf["cid"].to_numpy()[at], "n": pdf["n"].to_numpy()[at], "sk": pdf["sk"].to_numpy()[at]})

    row = "node bigint, cid bigint, n int, sk binary"
    level = sets.mapInPandas(roots, row)
    found = []
    for depth in range(LEVELS):
        out = cut(level.repartition("node").sortWithinPartitions("node", "n").mapInPandas(compare, "node bigint, a bigint, b bigint, n int, sk binary"))
        found.append(out.where("b is not null").select("a", "b", F.col("n").alias("halves")))
        large = out.where("b is null").select("node", F.col("a").alias("cid"), "n", "sk")
        if large.isEmpty():
            break
        # branching may lose pairs of a dense group, which shrinks in no round: what fits a block is compared whole at once
        if depth < min(1, LEVELS - 1):
            huge = cut(large.groupBy("node").count().where(F.col("count") > BLOCK_ROWS).select("node"))
            found.append(_blocks(large.join(huge, "node", "left_anti"), least, differing))
            large = large.join(huge, "node", "left_semi")
        else:
            found.append(_blocks(large, least, differing))
            break
        if huge.isEmpty():
            break
        # a large node is one whose members are all here; a record's nodes travel together
        held = large.groupBy("cid").agg(F.collect_list("node").alias("nodes"), F.first("sk").alias("sk"))
        level = sets.join(held, "cid").select("cid", "n", "tokens", "nodes", "sk").mapInPandas(branch, row)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy("a", "b").agg(F.bit_or("halves").alias("halves"))


def _blocks(large: DataFrame, least: float, differing: int) -> DataFrame:
    """Pairs of nodes that stay large: every block of a node against every other, each pair of blocks a task of its own."""
    size = large.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = large.join(size, "node").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    rows = own.select("node", "cid", "n", "sk", "i", other).select("node", "cid", "n", "sk", (F.col("i") <= F.col("j")).alias("low"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        a, b = (pdf, pdf) if one else (pdf[pdf["low"]], pdf[~pdf["low"]])
        sa, sb, na, nb = _words64(a["sk"]), _words64(b["sk"]), a["n"].to_numpy(), b["n"].to_numpy()
        ca, cb, left, right = a["cid"].to_numpy(), b["cid"].to_numpy(), [], []
        for i in range(0, len(sa), 64):
            fits = (np.minimum(na[i : i + 64, None], nb) >= least * np.maximum(na[i : i + 64, None], nb)) & (ca[i : i + 64, None] != cb)
            r, c = np.nonzero(fits)
            ok = np.bitwise_count(sa[i + r] ^ sb[c]).sum(1) <= differing
            left.append(np.minimum(ca[i + r[ok]], cb[c[ok]]))
            right.append(np.maximum(ca[i + r[ok]], cb[c[ok]]))
        out = pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *left]), "b": np.concatenate([np.zeros(0, np.int64), *right])})
        return out.assign(halves=1 + (int(pdf["node"].iloc[0]) & 1))

    return rows.groupBy("node", "i", "j").applyInPandas(block, "a bigint, b bigint, halves int")


def near_duplicates(df: DataFrame, columns: list[str], least: float = 0.75, min_words: int = 12, id_col: str = "id") -> DataFrame:
    """(id_a, id_b), smaller first: records whose words, counted as often as they occur, overlap by ``least`` or more.

    Words are runs of letters and digits of all ``columns`` together in lower
    case; null columns count as empty and records of fewer words are in no pair.
    Records of equal word counts form one class that is joined once; classes are
    expanded to pairs only at the end. Ids must be unique and are compared as text; null ids
    are left out. An empty table gives no pairs.
    """
    records = cut(prepare(df, columns, min_words, id_col))
    kinds = records.groupBy("kind").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    sets = cut(records.join(kinds.select("id"), "id", "left_semi").select("kind", "n", "tokens").withColumn("cid", F.monotonically_increasing_id()))
    members = records.select("id", "kind").join(sets.select("kind", "cid"), "kind").select("cid", "id")
    links = similar_pairs(sets.select("cid", "n", "tokens"), least)
    sized = kinds.where("copies > 1").join(sets.select("kind", "cid"), "kind").select("cid", F.ceil(F.col("copies") / CLASS_ROWS).cast("int").alias("blocks"))
    # a class's pairs are dealt to tasks by pairs of blocks: block i of its rows meets block j of them
    own = members.join(sized, "cid").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select("cid", "i", every.alias("j"), F.col("id").alias("id_a"))
    right = own.select("cid", every.alias("i"), F.col("i").alias("j"), F.col("id").alias("id_b"))
    within = left.join(right, ["cid", "i", "j"]).where("id_a < id_b").select("id_a", "id_b")
    across = (
        links.join(members.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a")  # copies of both sides are pairs by the definition
        .join(members.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return within.unionByName(across)
