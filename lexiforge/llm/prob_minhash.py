"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A document is the set of its shingles of five words (lower-cased, cut at white space; a shorter text is one shingle), of equal
weight, as links are pairs of sets. Each shingle is a Poisson process of arrivals with its weight as rate; an arrival falls into
one of the signature's components at random, and a component keeps the shingle that arrives first. A shingle
is left as soon as its next arrival is later than the latest first arrival of all components. Two documents
agree in a component with the probability Jaccard similarity of their shingles, which is that of the sets.

Bands of signature components make buckets. Equal texts are one node beforehand. In each bucket nodes are
held against the node that shares most buckets with others; what is not yet connected is then held
against all other members of the bucket, those of the highest signature estimate first; only pairs that cannot reach the
threshold by their sizes or marked shingles (``possible``) are skipped. Links are pairs with an exact Jaccard similarity of the
shingle sets of at least the threshold. Classes are the connected components of the links.

Defined results: null counts as empty; all texts without a word are equal; repeated rows are copies; a class
is named by its least id (null if no member has one); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm.common import free_name, from_worker, materialise, small_batches, to_worker, trim

U = np.uint64
BANDS, ROWS = 25, 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False).astype(U, copy=False)


def shingles(hashes: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each of several texts, whose words' hashes follow one another; sizes are their words."""
    joined = np.zeros(max(len(hashes) - width + 1, 0), U)
    for j in range(width if len(joined) else 0):
        joined = mix(joined * U(0x9E3779B97F4A7C15) + hashes[j : len(joined) + j] + U(1))
    out, end = [], 0
    for size in sizes.tolist():
        start, end = end, end + size
        if size >= width:
            found = joined[start : end - width + 1]
        else:  # a short text is one shingle
            found = np.zeros(min(size, 1), U)
            for h in hashes[start:end]:
                found = mix(found * U(0x9E3779B97F4A7C15) + h + U(1))
        found = np.sort(found)
        out.append(found[np.diff(found, prepend=found[:1] ^ U(1)) != 0])
    return out


def arrivals(elements: np.ndarray, weights: np.ndarray | float, serial: np.ndarray | int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The waiting times and components of elements' arrivals of that serial number; the same in every document."""
    r = mix(elements + (np.atleast_1d(serial).astype(U) * U(2) + U(1)) * U(0xD1342543DE82EF95))
    gap = -np.log(((r >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / weights
    return gap, (mix(r ^ U(0xA0761D6478BD642F)) % U(m)).astype(np.int64)


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The m components (elements' hashes) of a ProbMinHash signature of distinct elements; zeros where there are none."""
    first, who = np.full(m, np.inf), np.zeros(m, U)
    if not len(elements):
        return who
    active, at, step = np.arange(len(elements)), np.zeros(len(elements)), 0
    burst = max(1, int(np.ceil(1.5 * m * np.log(m) / len(elements))))
    while len(active):
        gap, component = arrivals(elements[active][:, None], weights[active][:, None], np.arange(step, step + burst), m)
        gap[:, 0] += at[active]
        time = np.cumsum(gap, axis=1)
        t, c = time.ravel(), component.ravel()
        np.minimum.at(first, c, t)
        better = np.flatnonzero(t == first[c])
        who[c[better]] = elements[active][better // burst]
        at[active] = time[:, -1]
        active = active[at[active] < first.max()]
        step, burst = step + burst, 1 if np.isfinite(first).all() else burst
    return who


def signatures(documents: list[np.ndarray], m: int) -> np.ndarray:
    """The signatures of several documents' equally weighted elements, a row for each.

    Documents of many elements take their arrivals together, one of each element that is not yet left in each step; documents of
    few elements, which need many arrivals of each, one after another. Both ways give the same signatures.
    """
    who = np.zeros((len(documents), m), U)
    many = [i for i, e in enumerate(documents) if 2 * len(e) >= m]
    for i, e in enumerate(documents):
        if 2 * len(e) < m:
            who[i] = signature(e, np.ones(len(e)), m)
    if not many:
        return who
    first, found = np.full((len(many), m), np.inf), np.zeros((len(many), m), U)
    earliest, element = first.ravel(), found.ravel()  # views
    elements = np.concatenate([documents[i] for i in many])
    doc = np.repeat(np.arange(len(many)), [len(documents[i]) for i in many])
    at, step = np.zeros(len(elements)), 0
    while len(elements):
        gap, component = arrivals(elements, 1.0, step, m)
        at += gap
        slot = doc * m + component
        early = np.flatnonzero(at < earliest[slot])
        t, c = at[early], slot[early]
        np.minimum.at(earliest, c, t)
        better = t == earliest[c]
        element[c[better]] = elements[early][better]
        open_ = at < first.max(axis=1)[doc]
        elements, doc, at, step = elements[open_], doc[open_], at[open_], step + 1
    who[many] = found
    return who


def band_hashes(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hashes of the bands of signatures, a row for each."""
    h = np.broadcast_to(np.arange(bands, dtype=U), (len(sigs), bands))
    for j in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + sigs.reshape(-1, bands, rows)[:, :, j])
    return h.astype(np.int64)


#: 4-bit signature components in a 64-bit word, and the bits that are left when a component's differences are folded.
NIBBLES, FOLDED = 16, 0x1111111111111111


def brief(sigs: np.ndarray) -> np.ndarray:
    """Four bits of each component, 16 components to an integer, a row for each signature; the last is filled up with zeros."""
    m = sigs.shape[1]
    bits = np.zeros((len(sigs), -(-m // NIBBLES) * NIBBLES), U)
    bits[:, :m] = mix(sigs + U(0x5851F42D4C957F2D)) & U(15)
    out = np.zeros((len(sigs), bits.shape[1] // NIBBLES), U)
    for j in range(NIBBLES):
        out |= bits[:, j::NIBBLES] << U(4 * j)
    return out.view(np.int64)


def agreeing(a: str, b: str, m: int) -> str:
    """SQL for the number of components in which two brief signatures agree."""
    words = -(-m // NIBBLES)
    one = "bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & " + str(FOLDED) + "L)"
    return f"({m} - (" + " + ".join(one.format(x=f"({a}[{i}] ^ {b}[{i}])") for i in range(words)) + "))"


#: Bits of a document's marks.
MARKS = 1024


def marks(elements: np.ndarray) -> np.ndarray:
    """A bit set for each element's hash, in 64-bit integers."""
    bits = np.zeros(MARKS, np.uint8)
    bits[elements % U(MARKS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def possible(a: str, b: str, threshold: float) -> str:
    """SQL that is false only if the sets a, b (n, marks) cannot have the threshold's similarity.

    Each bit that a alone has stands for an element at least that is not in b, so the common elements are no more than a's others.
    """
    only = [" + ".join(f"bit_count({x}.marks[{i}] & ~{y}.marks[{i}])" for i in range(MARKS // 64)) for x, y in ((a, b), (b, a))]
    return f"{1 + threshold} * least({a}.n - ({only[0]}), {b}.n - ({only[1]})) >= {threshold} * ({a}.n + {b}.n) - 1e-6"


def _runs_of(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes come to most, or a little more, or of a single larger one."""
    at = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def sketch(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, node (a digest of the words), n (distinct shingles), bands, brief, marks, packed (the words, compressed); a narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in _runs_of(b["content"].str.len().to_numpy(), 200_000):
                texts = [t.lower().split() for t in b["content"].iloc[part]]
                raw = [" ".join(words).encode("utf-8", "surrogatepass") for words in texts]
                elements = shingles(word_hashes([w for words in texts for w in words]), np.array([len(words) for words in texts]), width)
                sigs = signatures(elements, bands * rows)
                in_bands = band_hashes(sigs, bands, rows)
                yield pd.DataFrame({
                    "id": b["id"].iloc[part].to_numpy(),
                    "text_hash": b["text_hash"].iloc[part].to_numpy(),
                    "node": [hashlib.blake2b(r, digest_size=16).digest() for r in raw],
                    "n": [len(e) for e in elements],
                    "bands": [h if len(e) else h[:0] for h, e in zip(in_bands, elements, strict=True)],
                    "brief": list(brief(sigs)),
                    "marks": [marks(e) for e in elements],
                    "packed": [squeeze.compress(r) for r in raw],
                })
            trim()

    keyed = docs.select(to_worker(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).withColumn("text_hash", F.xxhash64("content"))
    out = keyed.mapInPandas(run, "id string, text_hash long, node binary, n int, bands array<long>, brief array<long>, marks array<long>, packed binary")
    return out.withColumn("id", from_worker("id", kind))


def similar(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """a, b of those pairs whose shingle sets have at least the threshold's Jaccard similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}  # of texts that many pairs share; bounded by their shingles
        size = 0

        def of(node: bytes, packed: bytes) -> np.ndarray:
            nonlocal size
            if node not in known:
                if size > 500_000:
                    known.clear()
                    size = 0
                words = open_.decompress(packed).decode("utf-8", "surrogatepass").split()
                known[node] = shingles(word_hashes(words), np.array([len(words)]), width)[0]
                size += len(known[node]) + 50
            return known[node]

        for p in batches:
            keep = []
            for a, b, pa, pb in zip(p["a"], p["b"], p["pa"], p["pb"], strict=True):
                x, y = of(a, pa), of(b, pb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield p.loc[keep, ["a", "b"]]
            trim()

    return both.select("a", "b", "pa", "pb").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, root of each node of the links: the least node of its connected component.

    Rounds of hooking to the least neighbour's root and halving of paths, each written to the shared folder;
    the number of rounds grows with the logarithm of a component's diameter.
    """
    spark = links.sparkSession
    ab = links.select(F.col("a"), F.col("b"))
    edges = materialise(spark, ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    roots = materialise(spark, edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), label)
    while True:
        # a root takes the least root that any of its members' neighbours has
        seen = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").groupBy("a").agg(F.min("rb").alias("rb"))
        offers = seen.join(roots.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.min("rb").alias("rb")).select(F.col("root").alias("r"), F.least("root", "rb").alias("to"))
        hooked = roots.join(offers, roots["root"] == offers["r"]).select("node", F.col("root").alias("old"), F.col("to").alias("root"))
        jump = hooked.select(F.col("node").alias("r"), F.col("root").alias("to"))
        new = hooked.join(jump, hooked["root"] == jump["r"]).select("node", F.col("to").alias("root"), "old")
        new = materialise(spark, new, label)
        roots = new.select("node", "root")
        if new.filter("root != old").isEmpty():
            return roots


def joined(root: DataFrame, links: DataFrame, label: str = "classes") -> DataFrame:
    """node, root after further links; root itself where no link joins two classes.

    Only the classes that a link joins go through components(), each as one node.
    """
    spark = links.sparkSession
    ends = materialise(spark, _apart(links, root).distinct(), "class-links")
    if ends.isEmpty():
        return root
    found = components(ends).select(F.col("node").alias("r"), F.col("root").alias("to"))
    return materialise(spark, root.join(found, root["root"] == found["r"], "left").select("node", F.coalesce("to", "root").alias("root")), label)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, class_size, kept, text_hash for each row of docs; kept is true for one row of each class, that of the least id."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, threshold, width, bands, rows, id_col, text_col)


def _near_duplicates(docs: DataFrame, threshold: float, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sk = materialise(spark, sketch(docs, width, bands, rows, id_col, text_col), "sketches")
    nodes = materialise(spark, sk.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("brief").alias("brief"), F.first("marks").alias("marks")), "nodes")
    spread = nodes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    crowded = spread.groupBy("band", "h").agg(F.count("*").alias("k")).filter("k > 1")
    member = materialise(spark, spread.join(crowded, ["band", "h"]), "buckets")
    degree = materialise(spark, member.groupBy("node").agg(F.sum("k").alias("degree")), "degrees").hint("merge")  # grows with the input: never broadcast, small as it may be
    member = materialise(spark, member.join(degree, "node"), "ranked-buckets")
    texts = materialise(spark, sk.select("node", "packed").join(degree.select("node"), "node", "left_semi").dropDuplicates(["node"]), "candidate-texts")
    fits = F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")

    # first each node against the hub that it shares most buckets with
    hub = member.groupBy("band", "h").agg(F.max(F.struct("degree", "node", "n")).alias("hub")).select("band", "h", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    met = member.join(hub, ["band", "h"]).filter(F.col("node") != F.col("hub")).filter(fits).groupBy("node", "hub").agg(F.count("*").alias("shared")).filter("shared >= 2")
    met = materialise(spark, met, "hub-pairs")
    best = met.groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    root = joined(degree.select("node", F.col("node").alias("root")), similar(best, texts, threshold, width))
    rest = met.select(F.col("node").alias("a"), F.col("hub").alias("b")).join(best, ["a", "b"], "left_anti")
    root = joined(root, similar(_apart(rest, root, ("a", "b")), texts, threshold, width))

    # then, in buckets that still hold several classes, all members outside the largest class against the others, the
    # pairs of the highest estimates first: classes grow together, and what is then of one class needs no comparison
    for low, high in ((threshold, 2.0), (threshold - 0.1, threshold), (-1.0, threshold - 0.1)):
        cross = _across(member, nodes, root, threshold, low, high, bands * rows)
        root = joined(root, similar(cross, texts, threshold, width))

    named = nodes.select("node", "id", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialise(spark, named.select("node", "root").join(classes, "root"), "classes")
    rows_ = sk.select("id", "text_hash", "node").withColumn("row", F.monotonically_increasing_id()).join(named, "node")
    keep = rows_.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("k")).select("root", F.col("k.row").alias("keep_row"))
    out = rows_.join(keep, "root").select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_hash")
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of docs that each class keeps; rows that repeat id and text count once."""
    kid, kh = "kept id", "kept hash"
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(F.col(id_col).alias(kid), F.col("text_hash").alias(kh))
    mark = free_name(docs, "_h")
    rows = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(kept, rows[id_col].eqNullSafe(kept[kid]) & (rows[mark] == kept[kh]), "left_semi")
    return out.dropDuplicates([id_col, mark]).select(*docs.columns)


def _across(member: DataFrame, nodes: DataFrame, root: DataFrame, threshold: float, low: float, high: float, m: int) -> DataFrame:
    """a, b of different classes that share a bucket and whose estimated similarity is at least low and below high.

    Pairs that are not ``possible`` are left out; each other pair comes once, from its first bucket.
    """
    placed = member.select("band", "h", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_class = placed.groupBy("band", "h", "root").agg(F.count("*").alias("c"))
    split = by_class.groupBy("band", "h").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("classes")).filter("classes > 1").select("band", "h", F.col("top.root").alias("top"))
    placed = placed.join(split, ["band", "h"]).join(nodes.select("node", "n", "bands", "brief", "marks"), "node")
    placed = materialise(member.sparkSession, placed, "split-buckets")
    few = placed.filter("root != top").alias("x")
    other = placed.alias("y")
    least, most = (m * (x * 15 / 16 + 1 / 16) for x in (low, high))  # unlike components agree in their four bits in one of 16 cases
    once = "(x.root = x.top OR y.root = y.top OR x.node < y.node)"  # of two nodes outside the largest class, the pair from one side
    first = "array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = x.band + 1"
    same = f"x.band = y.band AND x.h = y.h AND x.root != y.root AND least(x.n, y.n) >= {threshold} * greatest(x.n, y.n)"
    cross = few.join(other, F.expr(f"{same} AND {once} AND {agreeing('x.brief', 'y.brief', m)} >= {least} AND {agreeing('x.brief', 'y.brief', m)} < {most} AND {first} AND {possible('x', 'y', threshold)}"))
    return cross.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def _apart(pairs: DataFrame, root: DataFrame, out: tuple[str, str] = ("ra", "rb")) -> DataFrame:
    """a, b: the roots (or, with out, the nodes) of the pairs whose nodes are in different classes."""
    for x in ("a", "b"):
        r = root.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        pairs = pairs.join(r, x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    return pairs.filter("ra != rb").select(F.col(out[0]).alias("a"), F.col(out[1]).alias("b"))
