"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle's weight in a document is how often it stands there. Each shingle has a Poisson process
whose rate is its weight and whose points, made from the shingle's hash, fall on registers at
random; a register keeps the shingle of its earliest point. Two documents agree in a register
with the probability of their probability Jaccard similarity, the sum over common shingles d of
1 / sum over e of max(x_e / x_d, y_e / y_d), which is the plain Jaccard similarity when all
weights are equal. Points later than a document's latest register are never made.

Registers are banded. In each bucket all documents are compared with the bucket's smallest, and
verified exactly on their shingles. A family is what these candidate pairs connect. Families whose
documents are then still in different groups are compared across these groups, in blocks, first by
registers and then exactly, so that no link is lost to the choice of the smallest; a block's task
gives only links that join two groups. Families too wide for that are compared bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import KeyFilter, arrow_schema, columns, give_back, kind_of, materialize, mix, only_likely, rows_of, text_batches, with_likely
from panelwise.llm.graph import components
from panelwise.llm.words import Words, shingles

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
BLOCK = 512  # documents compared with another such block in a task
FAMILY = 50_000  # wider families are compared bucket by bucket
SLACK = 0.1  # registers may show this much less than the threshold: over three standard deviations


def weighted(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, count."""
    h, text = shingles(Words.of(texts), k)
    key = h ^ mix(text.astype(np.uint64))  # one key to sort by
    order = np.argsort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(new)
    return h[order[at]], text[order[at]], np.diff(np.append(at, len(order)))


def registers(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m shingle hashes, 0 for texts without shingles."""
    earliest = np.full(n * m, np.inf)
    kept = np.zeros(n * m, dtype=np.uint64)
    rate, time, point = 1.0 / weight, np.zeros(len(h)), 0
    while len(h):
        point += 1
        x = mix(h + np.uint64(point * 0xD1342543DE82EF95 & (1 << 64) - 1))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        slot = text * m + ((x & np.uint64(0x7FF)).astype(np.int64) * m >> 11)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        kept[slot[won]] = h[won]
        going = time < earliest.reshape(n, m).max(axis=1)[text]
        h, text, rate, time = h[going], text[going], rate[going], time[going]
    return kept.reshape(n, m)


def signature(texts: list[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers of the texts, and which texts have any words."""
    h, text, weight = weighted(texts, k)
    has = np.zeros(len(texts), dtype=bool)
    has[text] = True
    return registers(h, text, weight, len(texts), m), has


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact, from distinct hashes in ascending order and their weights."""
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a = np.concatenate([wa.astype(float), np.zeros(len(hb) - len(both))])
    b = np.zeros(len(a))
    b[ia] = wb[ib]
    b[len(ha):] = np.delete(wb, ib)
    ratio = np.divide(b, a, out=np.full(len(a), np.inf), where=a > 0)
    order = np.argsort(ratio, kind="stable")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(a[order])]), np.concatenate([[0], np.cumsum(b[order])])
    mine = ratio[ia]
    upto = np.searchsorted(ratio[order], mine, "right")
    return float(np.sum(a[ia] / (sum_a[upto] + (sum_b[-1] - sum_b[upto]) / mine)))


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    spec, schema = arrow_schema(pairs, "a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            if text not in known:
                if len(known) > 500:
                    known.clear()
                h, _, w = weighted([text], k)
                order = np.argsort(h)
                known[text] = h[order], w[order]
            return known[text]

        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            ok = np.array([probability_jaccard(*of(x), *of(y)) >= threshold - 1e-12 for x, y in zip(left, right, strict=True)], dtype=bool)
            yield rows_of(schema, a=batch.column("a").to_numpy()[ok], b=batch.column("b").to_numpy()[ok])
        known.clear()
        give_back()

    one, other = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(other, "b").join(one, "a").mapInArrow(run, spec)


def texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the wanted nodes; other texts mostly do not reach the shuffle."""
    nodes = materialize(nodes)
    return only_likely(texts, KeyFilter.of(nodes, "node"), "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def across(rows: DataFrame, k: int, threshold: float, slack: float = SLACK) -> DataFrame:
    """Verified pairs (a, b) of different components in one group, enough to connect what is linked.

    ``rows``: group, node, component, registers, text. A group's nodes are dealt into blocks of about
    ``BLOCK`` by hash and each pair of blocks is compared in a task of its own: every pair of
    different components whose registers agree nearly enough, unless its components are
    connected already.
    """
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets blocks i..: every pair of blocks once
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("*", meets.alias("with")).select(
        "group", "node", "component", "registers", "text", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    )
    spec, schema = arrow_schema(rows, "a long, b long")

    def pairs(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(groups)
        node, component = got.column("node").to_numpy(), got.column("component").to_numpy()
        block, i, j = got.column("block").to_numpy(), got.column("i")[0].as_py(), got.column("j")[0].as_py()
        marks = np.frombuffer(b"".join(got.column("registers").to_pylist()), dtype="<u2").reshape(len(node), -1)
        rest = np.flatnonzero(block == j)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in np.flatnonzero(block == i):
            y = rest[(component[rest] != component[x]) & ((node[rest] > node[x]) | (i != j))]
            if len(y):
                agree = (marks[y] == marks[x]).mean(axis=1)
                ok = agree >= threshold - slack
                near.append((agree[ok], np.full(ok.sum(), x), y[ok]))
        if not near:
            return
        agree, left, right = (np.concatenate(c) for c in zip(*near, strict=True))
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = parent[c]
            return c

        texts, known, out = got.column("text"), {}, []

        def of(n: int) -> tuple[np.ndarray, np.ndarray]:
            if n not in known:
                h, _, w = weighted([texts[n].as_py()], k)
                order = np.argsort(h)
                known[n] = h[order], w[order]
            return known[n]

        for at in np.argsort(-agree, kind="stable").tolist():
            x, y = int(left[at]), int(right[at])
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q and probability_jaccard(*of(x), *of(y)) >= threshold - 1e-12:
                parent[q] = p
                out.append(sorted((int(node[x]), int(node[y]))))
        yield rows_of(schema, a=[a for a, _ in out], b=[b for _, b in out])

    return dealt.groupBy("group", "i", "j").applyInArrow(pairs, spec).distinct()


def near_links(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different texts that connect every group, and its groups (node, component).

    ``docs``: node (one for each text), text. Texts without words have no links.
    """
    m = bands * rows
    spec, schema = arrow_schema(docs, "node long, buckets array<long>, registers binary")

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            kept, has = signature(texts, k, m)
            part = kept.reshape(len(texts), bands, rows)
            h = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)
            for r in range(rows):
                h = mix(h ^ part[:, :, r])
            flat = pa.array(h[has].view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, has.sum() * bands + 1, bands), pa.int32()), flat)
            short = kept[has].astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(has)), lists.cast(schema.field("buckets").type), pa.array([s.tobytes() for s in short], pa.binary())], schema=schema)

    signed = materialize(docs.mapInArrow(sign, spec).dropDuplicates(["node"]))
    dealt = signed.select(F.explode("buckets").alias("bucket"), "node")
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("bucket", "a")
    shared = materialize(dealt.join(shared, "bucket"))  # bucket, node, a: rows of buckets with several texts
    # One link to the smallest centre a text meets, and the pairs of that one and its other centres: they connect
    # what all its buckets connect. The other centres are tried where that has not put a text and a centre together.
    met = materialize(shared.where("node != a").groupBy("node").agg(F.min("a").alias("least"), F.collect_set("a").alias("centres")))
    between = met.select("least", F.explode("centres").alias("b")).where("least != b").distinct()
    star = materialize(met.select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(between.select(F.col("least").alias("a"), "b")).distinct())
    texts = materialize(texts_of(docs, shared.select("node").distinct()))
    sure = materialize(verified(star, texts, k, threshold))
    near = components(sure)
    at = lambda name, over: near.select(F.col("node").alias(name), F.col("component").alias(over))
    others = met.where("size(centres) > 1").select("node", F.explode("centres").alias("a")).join(at("node", "x"), "node", "left").join(at("a", "y"), "a", "left")
    apart = F.coalesce("x", "node") != F.coalesce("y", "a")
    more = materialize(verified(materialize(others.where(apart).select("a", F.col("node").alias("b")).join(star, ["a", "b"], "left_anti")), texts, k, threshold))
    first = sure.unionByName(more)
    group = components(first) if more.limit(1).count() else near
    named = signed.select("node", "registers").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    family = components(star).withColumnRenamed("component", "family")
    members = materialize(named.join(family, "node"))
    split = members.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x < y")
    some = materialize(members.join(split.select("family", "size"), "family").select("node", "component", "registers", "family", "size"))
    wide = some.where(F.col("size") > FAMILY).join(shared.select("bucket", "node"), "node").select(F.col("bucket").alias("group"), "node", "component", "registers")
    narrow = some.where(F.col("size") <= FAMILY).select(F.col("family").alias("group"), "node", "component", "registers")
    second = materialize(across(narrow.unionByName(wide).join(texts, "node"), k, threshold))
    links = first.unionByName(second)
    return links, components(links) if second.limit(1).count() else group


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of the table: doc_id, class_id, n_members, kept.

    ``class_id`` is the smallest id of the row's group of exact and near copies, ``n_members`` its
    rows; one row of each group is kept, that with the smallest id. Equal texts are one node, by
    64-bit hash. Null and empty texts, and rows without a copy, are groups of their own. Rows
    without an id come after those with one. Repeated rows are copies of each other; an empty table
    gives none.
    """
    docs = columns(df, doc_id=doc_id, text=text).withColumn("node", F.xxhash64("text"))
    members = materialize(docs.groupBy("doc_id", "node", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("bare")).agg(F.count("*").alias("n")))
    _, group = near_links(docs.where("length(text) > 0").select("node", "text"), **how)
    rows = members.join(group, "node", "left").withColumn(
        "class", F.when(~F.col("bare"), F.struct(F.lit(None).cast("long").alias("alone"), F.coalesce("component", "node").alias("of"))).otherwise(
            F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("alone"), F.lit(0).cast("long").alias("of")))
    ).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    heads = rows.groupBy("class").agg(F.min("rank").alias("head"), F.sum("n").alias("n_members"))
    named = rows.join(heads, rows["class"].eqNullSafe(heads["class"])).select(
        "doc_id", "node", "n", "bare", F.col("head.doc_id").alias("class_id"), "n_members", (F.col("rank") == F.col("head")).alias("kept")
    )
    copies = named.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    alone = F.col("bare")
    return copies.select(
        "doc_id", "class_id", F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n_members")).alias("n_members"),
        (alone | (F.col("kept") & (F.col("copy") == 1))).alias("kept"), "node",
    )


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The table with one row of each group of copies, all columns as they were.

    Rows whose text is surely in no group are kept as they are; only the others, kept once as a table, meet the decisions.
    """
    found = near_duplicates(df, doc_id, text, **how)
    gone = found.groupBy("doc_id", "node").agg(F.max(F.col("kept").cast("int")).alias("_stays"), F.count("*").alias("_copies"), F.sum(F.col("kept").cast("int")).alias("_kept"))
    gone = materialize(gone.where("_stays = 0 OR _copies > _kept").select(F.col("doc_id").alias("_doc_id"), F.col("node").alias("_node"), "_stays"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(whole.alias("_row"), F.xxhash64(F.col(f"`{text}`")).alias("_node_"))
    rows = with_likely(rows, KeyFilter.of(gone, "_node"), "_node_", "_likely")
    some = materialize(rows.where("_likely"))
    marked = some.join(gone, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_doc_id")) & (F.col("_node_") == F.col("_node")), "left")
    once = rows.where("NOT _likely").select("_row").unionByName(marked.where("_stays IS NULL").select("_row"))
    twice = marked.where("_stays = 1").dropDuplicates(["_doc_id", "_node"])
    return once.unionByName(twice.select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
