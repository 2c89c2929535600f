"""Near-duplicate documents by an inverted join on MinHash signature coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import cut, give_back, parallelism, pieces_of, ship
from docstrand.llm.components import components
from docstrand.llm.hashing import shingles, words

#: Coordinates of a signature, and how many of them a retained pair must share. At a similarity of 0.75 a pair shares
#: 24 +- 2.4 of 32; it shares fewer than 14 with a probability of about 4 in 100,000.
COORDINATES, MATCHES = 32, 14
#: A pair that shares MATCHES coordinates shares one of the first PREFIX of both, in any one order of all coordinate values.
PREFIX = COORDINATES - MATCHES + 1
#: Members of a posting list that one task compares together, and the bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Entries of posting lists that are merged at once.
MERGED = 1 << 16
#: Members that are compared with the smallest member of their list in one task.
HUB_BLOCK = 4096
#: Bytes up to which a table of ids may be broadcast.
BROADCAST = 32 << 20

_RANDOM = np.random.default_rng(77)
_A = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64)


def signatures(docs: DataFrame, words_in_a_row: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (16 bytes: equal for equal sets; null for an empty one), sig (COORDINATES 32-bit
    values) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text", 1 << 20):
            flat, at = shingles(*words(b.column("text").to_pylist()), b.num_rows, words_in_a_row)
            n = np.diff(at)
            full = np.flatnonzero(n)
            sig = np.zeros((b.num_rows, COORDINATES), np.uint32)
            if len(full):
                for k in range(COORDINATES):
                    sig[full, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), at[full])
            prints = [hashlib.blake2b(flat[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(at[:-1], at[1:])]
            sigs = [x if k else None for x, k in zip(sig.view(np.int32), n)]
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "print", "sig"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, print binary, sig array<int>")


def ordered(reps: DataFrame) -> DataFrame:
    """node, n_shingles, sig, coords, prefix: the coordinates whose values a representative shares with others, the rarest
    value first, and how many of them are among its first PREFIX.

    Its other values are rarer still, so they come before these and use up places. A document with PREFIX values of its
    own is in no pair and is left out; that is most documents, also of those that share a common passage.
    """
    tokens = reps.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.col("at").cast("tinyint").alias("at"), F.xxhash64("at", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    of = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token", "at")))["at"].alias("coords"))
    of = of.withColumn("prefix", F.size("coords") - (COORDINATES - PREFIX)).where("prefix > 0")
    return of.join(reps.select("node", "n_shingles", "sig"), "node")


def postings(places: DataFrame) -> DataFrame:
    """A row (list, at, node) for each coordinate value in a document's prefix; at is the coordinate."""
    posted = places.select("node", "sig", F.explode(F.slice("coords", F.lit(1), F.col("prefix"))).alias("at"))
    value = F.element_at("sig", F.col("at").cast("int") + 1)
    return posted.select(F.xxhash64(F.col("at").cast("int"), value).alias("list"), "at", "node")


def matching(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs (a, b) that collide in MATCHES coordinates or more."""
    sig = places.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                one, two = (x.column(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
                yield x.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= MATCHES))

    return both.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, words_in_a_row: int) -> DataFrame:
    """node, members (the sorted 64-bit hashes of the full shingle set) of the checkpointed nodes (node, doc_id, text_hash).

    The nodes are broadcast if they take BROADCAST bytes at most, else joined by a shuffle. Of repeated rows a task
    returns the first.
    """
    small = nodes.count() * 40 <= BROADCAST
    ids = nodes.select("node", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    texts = docs.join(F.broadcast(ids) if small else ids, (docs["doc_id"] == F.col("of")) & (docs["text_hash"] == F.col("hash"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces_of(batches, "text", 1 << 20):
            new = []
            for x in b.column("node").to_pylist():
                new.append(x not in seen)
                seen.add(x)
            if not all(new):
                b = b.filter(pa.array(new))
            flat, at = shingles(*words(b.column("text").to_pylist()), b.num_rows, words_in_a_row)
            own = [flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.binary())], ["node", "members"])

    return texts.mapInArrow(sets, "node long, members binary")


def with_sets(rows: DataFrame, row_bytes: int, reps: DataFrame, docs: DataFrame, words_in_a_row: int) -> DataFrame:
    """Checkpointed rows with a node, and that node's shingle set; a shuffle joins them if the rows can't be broadcast."""
    nodes = cut(rows.select("node").distinct().join(reps.select("node", "doc_id", "text_hash"), "node"))
    small = rows.count() * row_bytes <= BROADCAST
    return sets_of(docs, nodes, words_in_a_row).join(F.broadcast(rows) if small else rows, "node")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold; sizes alone may rule it out."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words_in_a_row: int, percent: int) -> DataFrame:
    """Those of the checkpointed pairs (a, b) whose full shingle sets meet the threshold.

    Each b is brought before its a's, in as many blocks as their number asks for, so each set travels once a pair and
    a b with very many a's is many tasks' work.
    """
    hubs = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("blocks")))
    a = pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("a").alias("node"))
    b = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("b").alias("node"))
    rows = with_sets(cut(a.union(b)), 48, reps, docs, words_in_a_row).select("b", "block", "side", "node", "members")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for x in batches:
            keep = []
            for side, own in zip(x.column("side").to_pylist(), x.column("members")):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                keep.append(side == 1 and alike(hub, own, percent))
                if side == 0:
                    hub = own.copy()
            yield x.select(["node", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    dealt = rows.repartition(parallelism(docs.sparkSession), "b", "block").sortWithinPartitions("b", "block", "side").select("b", "side", "node", "members")
    return dealt.mapInArrow(confirm, "node long, b long").toDF("a", "b")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], row: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in the order of keys and row; of rows that agree in both, the first."""
    part: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in keys + row]
        apart = [np.concatenate([[last is None or c[0] != last[i]], c[1:] != c[:-1]]) for i, c in enumerate(cols)]
        last = tuple(c[-1] for c in cols)
        fresh = np.logical_or.reduce(apart)
        new = np.logical_or.reduce(apart[: len(keys)])[fresh]
        if not fresh.all():
            b = b.filter(pa.array(fresh))
        begin = np.flatnonzero(new)
        if (head := int(begin[0]) if len(begin) else b.num_rows) > 0:
            part.append(b.slice(0, head))
        for s, e in zip(begin, np.append(begin[1:], b.num_rows)):
            if part:
                yield pa.Table.from_batches(part)
            part = [b.slice(s, e - s)]
    if part:
        yield pa.Table.from_batches(part)


class Members:
    """One block of a posting list: members on the left, and on the right those to find collisions for."""

    def __init__(self, t: pa.Table):
        self.node, self.component, self.side, rest = (t[c].to_numpy() for c in ("node", "component", "side", "rest"))
        self.sig = t["sig"].combine_chunks().flatten().to_numpy().view(np.uint32).reshape(len(self.node), COORDINATES)
        self.at, self.rest = t["at"][0].as_py(), rest.astype(bool)
        self.prefix = t["prefix"].to_numpy()
        coords = t["coords"].combine_chunks()
        size = coords.value_lengths().to_numpy()
        rows = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        #: Where a coordinate stands in its member's order; COORDINATES where its value is not shared.
        self.rank = np.full(self.sig.shape, COORDINATES, np.int8)
        self.rank[rows, coords.flatten().to_numpy()] = place

    def collisions(self, first_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, matches): member numbers of the pairs that collide in MATCHES coordinates or more and lie in
        different components.

        The posting lists of the right members' prefixes are merged, which counts collisions there. The longer lists
        beyond are not: a pair that was met is looked up in them, any other is skipped, as it can't have enough. With
        first_only, only pairs count for which this list's value is the first that both prefixes share, as the pair comes up
        again in each other list they share.
        """
        left, right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        inside = self.rank < self.prefix[:, None]
        high = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        lists = (high | self.sig[left]).ravel()
        order = np.argsort(lists, kind="stable")
        lists, who = lists[order], left[order // COORDINATES]
        y, k = np.nonzero(inside[right])
        value = high[k] | self.sig[right[y], k]
        start = np.searchsorted(lists, value)
        size = np.searchsorted(lists, value, "right") - start
        work = np.cumsum(np.bincount(y, weights=size, minlength=len(right)))
        number = len(self.node)
        for part in np.split(np.arange(len(right)), np.flatnonzero(np.diff(work // MERGED)) + 1):
            if not len(part):
                continue
            these = slice(*np.searchsorted(y, [part[0], part[-1] + 1]))
            n, total = size[these], int(size[these].sum())
            entry = np.repeat(start[these] - (np.cumsum(n) - n), n) + np.arange(total)
            pair, met = np.unique(np.repeat(right[y[these]], n) * number + who[entry], return_counts=True)
            b, a = np.divmod(pair, number)
            # two members of the rest meet in both roles
            keep = (self.component[a] != self.component[b]) & (~self.rest[a] | (self.node[a] < self.node[b]))
            a, b, met = a[keep], b[keep], met[keep]
            for s in range(0, len(a), MERGED):
                yield from self._looked_up(a[s : s + MERGED], b[s : s + MERGED], met[s : s + MERGED], inside, first_only)

    def _looked_up(self, a: np.ndarray, b: np.ndarray, met: np.ndarray, inside: np.ndarray, first_only: bool) -> Iterator[tuple]:
        same = self.sig[a] == self.sig[b]
        matches = met + (same & ~inside[b]).sum(axis=1)
        keep = matches >= MATCHES
        if first_only and keep.any():
            both = np.where(same & inside[a] & inside[b], self.rank[b], COORDINATES)
            keep &= both.argmin(axis=1) == self.at
        if keep.any():
            yield a[keep], b[keep], matches[keep]


_KEYS = ["list", "i", "j"]


def hopeful(batches: Iterator[pa.RecordBatch], first_only: bool) -> Iterator[pa.RecordBatch]:
    """The members of each block that collide often enough with one of another component."""
    for t in grouped(batches, _KEYS, ["side", "node"]):
        m = Members(t)
        hit = np.zeros(len(m.node), bool)
        for a, b, _ in m.collisions(first_only):
            hit[a] = hit[b] = True
        if hit.any():
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()


def united(batches: Iterator[pa.RecordBatch], percent: int, first_only: bool) -> Iterator[pa.RecordBatch]:
    """Links between components of each block that hold confirmed pairs; a pair is compared if its components haven't
    met here yet, those with the most collisions first."""
    for t in grouped(batches, _KEYS, ["side", "node"]):
        m = Members(t)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["members"]]
        root = {int(c): int(c) for c in m.component}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out: list[tuple[int, int]] = []
        for a, b, matches in m.collisions(first_only):
            for k in np.argsort(-matches, kind="stable"):
                x, y = int(a[k]), int(b[k])
                one, two = find(int(m.component[x])), find(int(m.component[y]))
                if one != two and alike(sets[x], sets[y], percent):
                    root[max(one, two)] = min(one, two)
                    out.append((int(m.node[x]), int(m.node[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
    give_back()


def list_links(now: DataFrame, mixed: DataFrame, places: DataFrame, reps: DataFrame, docs: DataFrame, words_in_a_row: int, percent: int, first_only: bool) -> DataFrame:
    """Confirmed links (a, b) between different components that meet in a list (rows list, at, node, component in `now`)
    of the checkpointed lists in `mixed`.

    The members outside a list's largest component are compared with all, in blocks of both: first by their
    signatures alone; the sets of those that collide often enough are brought together then.
    """
    rows = now.select("list", "at", "node", "component").join(mixed, "list").withColumn("rest", F.col("component") != F.col("main"))
    place = F.xxhash64("node")

    def blocks(members: str, shingles_: str) -> Column:
        return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(shingles_) * 8 / BLOCK_BYTES)).cast("int")

    rows = rows.withColumns({"lefts": blocks("n", "size"), "rights": blocks("n_rest", "size_rest")})
    both = lambda block, n: F.pmod(place, F.col(n)).cast("int").alias(block)
    to_all = lambda block, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(block)
    cols = ["list", "at", "node", "component", "rest"]
    left = rows.select(*cols, F.lit(0).alias("side"), both("i", "lefts"), to_all("j", "rights"))
    right = rows.where("rest").select(*cols, F.lit(1).alias("side"), to_all("i", "lefts"), both("j", "rights"))
    narrow = left.unionByName(right).join(places.select("node", "sig", "coords", "prefix"), "node").select(*_KEYS, "side", "node", "at", "component", "rest", "sig", "coords", "prefix")
    schema = "list long, i int, j int, side int, node long, at tinyint, component long, rest boolean, sig array<int>, coords array<tinyint>, prefix int"
    order = (*_KEYS, "side", "node")
    found = cut(narrow.repartition(parallelism(docs.sparkSession), *_KEYS).sortWithinPartitions(*order).mapInArrow(lambda x: hopeful(x, first_only), schema))
    full = with_sets(found, 320, reps, docs, words_in_a_row)
    return full.repartition(parallelism(docs.sparkSession), *_KEYS).sortWithinPartitions(*order).mapInArrow(lambda x: united(x, percent, first_only), "a long, b long")


def mixed_lists(now: DataFrame, one_each: bool) -> DataFrame:
    """The lists that hold several components: their members, the component with the most of them (main), and how many
    members are outside of it (rest), with the shingles of both; with one_each the longest list of each smallest member."""
    parts = now.groupBy("list", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("first").alias("first"))
    lists = parts.groupBy("list").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("first").alias("first"), F.max(F.struct("n", "size", "component")).alias("most"), F.count("*").alias("parts")
    ).where("parts > 1")
    lists = lists.select("list", "first", "n", "size", (F.col("n") - F.col("most.n")).alias("n_rest"), (F.col("size") - F.col("most.size")).alias("size_rest"), F.col("most.component").alias("main"))
    if one_each:
        lists = lists.groupBy("first").agg(F.max_by(F.struct(*lists.columns), F.struct("n", "list")).alias("x")).select("x.*")
    return cut(lists.drop("first"))


def near_duplicates(docs: DataFrame, words_in_a_row: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, leads for every row.

    Documents with equal shingle sets are one representative from the start, the least by (doc_id, text). The
    coordinate values of all signatures are ordered by how many representatives have them; each representative is posted under the first
    PREFIX of its own, the only ones among which a pair with enough matches must meet. First every member of a list is
    paired with the list's smallest member; the pairs with MATCHES collisions are confirmed on the full sets and
    united into components. What is left to find are pairs of one list in different components, so lists that lie in one
    component, as those of near copies mostly do, are dropped. In the others, collisions of the members outside the largest
    component with all are counted by merging posting lists, block by block, and pairs that match and are not yet connected
    are confirmed: first in the longest list of each smallest member, then, with the components that this leaves, in all.
    No pair with enough matches is skipped unless its documents are connected already.

    component_id is the smallest doc_id of the component; kept is whether it is the row's own; leads is true in the rows of
    one text of each component only, the least by (doc_id, text_hash).

    Null doc_id: linked with nothing, component null, kept, leads. Null or blank text: n_shingles 0, linked with nothing.
    Repeated rows are one document in the linking, whose set is compared once, and a row each in the result. Rows of one
    doc_id with different texts are documents of their own: each has its own text's component, though both may be named by
    the same id. Ties need no order. A very long text takes a task some 60 bytes a word besides itself, and its set, 8
    bytes a shingle, must fit a task. An empty table gives no rows. Other columns of `docs` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = cut(signatures(docs, words_in_a_row))
    groups = rows.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "sig")).alias("r"))
    # the checkpoint settles which representative has which number
    reps = cut(groups.select(F.monotonically_increasing_id().alias("node"), "print", "r.*"))
    places = cut(ordered(reps))
    posts = postings(places)
    lists = cut(posts.groupBy("list").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("list", "first"))
    posted = cut(posts.join(lists, "list").select("list", "at", "node", "first"))

    star = posted.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    # cut, as components' own Python would else run beside it in each task
    found = components(cut(confirmed(cut(matching(star, places)), reps, docs, words_in_a_row, percent)))
    sized = posted.join(places.select("node", "n_shingles"), "node")
    for first_only in (False, True):
        now = sized.join(found, sized["node"] == found["id"], "left").select("list", "at", "node", "first", "n_shingles", F.coalesce("component", "node").alias("component"))
        now = cut(now)
        more = list_links(now, mixed_lists(now, not first_only), places, reps, docs, words_in_a_row, percent, first_only)
        found = components(cut(more).union(found.select("id", "component")))
    return labelled(rows, reps, found)


def labelled(rows: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its representative's component."""
    members = cut(reps.join(found, reps["node"] == found["id"], "left").select("print", "doc_id", "text_hash", F.coalesce("component", "node").alias("component")))
    least = cut(members.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("lead")))
    of = members.join(least, "component").select("print", "lead")
    out = rows.join(of, "print", "left").select("doc_id", "n_shingles", "text_hash", F.coalesce("lead.doc_id", "doc_id").alias("component_id"), "lead")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    leads = F.coalesce((F.col("doc_id") == F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash")), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", leads.alias("leads"))


def op5_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("text_hash", "leads")
