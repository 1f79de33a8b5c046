"""Near duplicates by an exact n-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles (tokens). Tokens have one global order: the rare ones
first, then the frequent ones by their number of documents. Two similar sets miss so few of
each other's tokens that already their prefixes must share something: a rare token, or, for
frequent tokens, which are dealt into small classes, two tokens of one class. A prefix is
therefore extended until it holds enough rare tokens and enough tokens beyond the first of
each class; rare tokens are indexed alone, frequent ones in pairs of a class. Everything
that shares an index entry is a candidate, and candidates are verified on whole sets.

What keeps groups of copies from being expanded into pairs:
* equal sets are one node from the start;
* every index entry first ties its members to one of them only, that with the fewest rare
  tokens (of copies with different changes the least changed, which most are similar to);
  after that, only members in different components still have to meet;
* a pair meets only if the number of differing bits of two parity sketches, a lower bound of
  the number of differing tokens, allows the similarity: first of 512 bits, then, for sets
  that these are too short for, of about a bit a token.
No pair is dropped except by a proof that it is not similar or already in one component.
What is left is verified on whole sets, under two independent hashes. Sets of one 64-bit
name that differ in a second hash get names of their own.

Bounds: the table of frequent tokens that is broadcast holds at most MAX_FREQUENT entries
(the limit from which a token is frequent rises until they fit); an entry of a rare token
thus has fewer members than that limit.

Nulls, empty texts and texts without words have no token and are linked with nothing. A
text of fewer words than a shingle has one token, the whole sequence. Repeated rows are
linked with each other; a null doc_id keeps its row and never names a component unless
there is no other. doc_ids are integers, other types are refused. Further columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from dqspark.llm import bloom
from dqspark.llm.common import cut, give_back, small_batches, stored
from dqspark.llm.components import connected
from dqspark.llm.counting import FLUSH_KEYS, RANGE, count_keys, cut_again, first_bits, heaviest, range_bits, spread, unpack
from dqspark.llm.textbuf import Words, mix, shingle_sets, slices

#: A token in at least so many documents is frequent; doubled until at most MAX_FREQUENT are.
FREQUENT, MAX_FREQUENT = 8, 1 << 18
#: Names of components that are broadcast at the end (of 17 bytes); more are joined by a shuffle.
MAX_NAMED = 1 << 20
#: Frequent tokens of a prefix for each class, about.
CLASS_TOKENS = 4
#: Growth of the lengths in a band; a set is indexed in its own band and looks into those below.
BAND = 1.25

_U = np.uint64
#: Counts and index entries go by the leading 48 bits of a hash, which pack well; where two
#: tokens share these, they count together and their entries fall together, to be told
#: apart by the verification.
TOP = _U(2**64 - 2**16)
#: This bit of an entry tells whether the set is indexed there or only looks there.
OWN = _U(2**16)


@dataclass(frozen=True)
class Similarity:
    """Shingles of so many words, linked if den * |intersection| >= num * |union|."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, total: Column) -> Column:
        """Least intersection of two sets with so many tokens together."""
        return F.ceil(total * self.num / (self.num + self.den)).cast("int")

    def least(self, n: int, m: int) -> int:
        """Least intersection of sets of n and m tokens."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def smallest(self, n: int) -> int:
        """Size of the smallest set that can be linked with one of n tokens."""
        return -(-self.num * n // self.den)


def band(n: int) -> int:
    """Of a set of n tokens: b with BAND ** b <= n < BAND ** (b + 1), about, and the same everywhere."""
    return int(np.floor(np.log(max(n, 1)) / np.log(BAND) + 1e-9))


def n_classes(b: int, s: Similarity) -> int:
    """Classes of frequent tokens in a band, from the length of its prefixes."""
    low = BAND**b
    return max(1, int(low * (s.den - s.num) / s.den / CLASS_TOKENS))


def prefix_keys(tokens: np.ndarray, place: np.ndarray, frequent: np.ndarray, missing: int, b: int, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set in band b, of rare tokens and of pairs, if so many tokens may be missing elsewhere.

    tokens: in the global order; frequent: whether each is; place: hash that deals tokens into classes.
    """
    classes = n_classes(b, s)
    n_rare = int(len(frequent) - np.count_nonzero(frequent))  # rare ones come first
    salt = _U((b + 1) * 0x9FB21C651E98DF25 & (2**64 - 1))
    if n_rare > missing:
        return mix(tokens[: missing + 1] ^ salt), tokens[:0]
    own = (place[n_rare:] % _U(classes)).astype(np.int64)
    # each frequent token counts but for the first of its class
    first = np.zeros(len(own), dtype=bool)
    where = np.unique(own, return_index=True)[1]
    first[where] = True
    reach = np.flatnonzero(n_rare + np.cumsum(~first) > missing)
    stop = int(reach[0]) + 1 if reach.size else len(own)
    head, own = tokens[n_rare : n_rare + stop], own[:stop]
    order = np.argsort(own, kind="stable")
    head, own = head[order], own[order]
    pairs = []
    for gap in range(1, len(head)):
        same = own[gap:] == own[:-gap]
        if not same.any():
            break
        lo, hi = np.minimum(head[:-gap][same], head[gap:][same]), np.maximum(head[:-gap][same], head[gap:][same])
        pairs.append(mix(mix(lo ^ salt) + hi))
    return mix(tokens[:n_rare] ^ salt), np.concatenate(pairs) if pairs else tokens[:0]


def _document_counts(documents: DataFrame, s: Similarity) -> DataFrame:
    """(key, w0) for tokens in at least FREQUENT documents; repeated texts count each."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for _, data, offsets in slices(batch.column(0)):
            found = np.concatenate(list(shingle_sets(Words(data, offsets), s.words))) & TOP
            yield found, []

    return count_keys(documents.select("text"), keys_of, 0, lambda w: w[0] >= FREQUENT)


def frequent_tokens(documents: DataFrame, s: Similarity) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys (ascending) and document counts of the frequent tokens, and the limit that made them so."""
    found, limit = heaviest(_document_counts(documents, s), "w0", FREQUENT, MAX_FREQUENT)
    return found["key"].to_numpy(dtype=np.int64).view(_U), found["w0"].to_numpy(dtype=np.int64), limit


#: Longs of the short parity sketch of a set: bit h(token) mod 512 is set if an odd number of tokens has it.
SKETCH = 8


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch of about a bit a token, in longs: a power of two of them, SKETCH at least."""
    bits = min(1 << 24, max(64 * SKETCH, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens >> _U(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


_SET_FIELDS = [("doc_id", pa.int64()), ("n", pa.int32()), ("odd", pa.int32()), ("sid", pa.int64()), ("check", pa.int64()), *[(f"b{k}", pa.int64()) for k in range(SKETCH)], ("wide", pa.list_(pa.int64())), ("rare", pa.binary()), ("pairs", pa.list_(pa.int64())), ("text_key", pa.int64())]


def set_names(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each set, from sums and parities of its tokens' hashes, and a second hash of it; 0 for the empty one."""
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    names, checks = np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
    own = np.flatnonzero(sizes)
    if own.size:
        flat = np.concatenate(found)
        starts = (np.cumsum(sizes) - sizes)[own]
        for out, salt in ((names, 7), (checks, 1009)):
            total = np.add.reduceat(mix(flat + _U(salt - 7)), starts)
            parity = np.bitwise_xor.reduceat(mix(flat + _U(salt)), starts)
            out[own] = mix(mix(total) + mix(parity * _U(3)) + mix(sizes[own].astype(_U) * _U(5))).view(np.int64)
    return names, checks


def _sets(documents: DataFrame, s: Similarity, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row for each document: its set's size, name, sketch and index entries."""
    frequent = documents.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                rows: list[list] = [[] for _ in range(SKETCH + 5)]
                found = list(shingle_sets(Words(data, offsets), s.words))
                names, checks = set_names(found)
                flat = np.concatenate(found)
                at = np.searchsorted(keys, flat & TOP)
                at[at == len(keys)] = 0
                often = keys[at] == flat & TOP if len(keys) else np.zeros(len(flat), dtype=bool)
                counted = np.where(often, counts[at], 0) if len(keys) else np.zeros(len(flat), dtype=np.int64)
                dealt, stop = mix(flat), 0
                for tokens in found:
                    n = len(tokens)
                    if not n:
                        for column, value in zip(rows, (0, 0, *[0] * SKETCH, None, b"", []), strict=True):
                            column.append(value)
                        continue
                    start, stop = stop, stop + n
                    order = np.argsort(counted[start:stop], kind="stable")  # tokens are ascending: ties go by hash
                    tokens_, known, place = tokens[order], often[start:stop][order], dealt[start:stop][order]
                    small = s.smallest(n)
                    rare, pairs = prefix_keys(tokens_, place, known, n - s.least(n, n), band(n), s)
                    rare, pairs, asks = [rare], [pairs], []
                    for b in range(band(small), band(n) + 1):
                        asks.append(prefix_keys(tokens_, place, known, n - small, b, s))
                    rare_all, pairs_all = np.unique(np.concatenate([a for a, _ in asks])), np.unique(np.concatenate([p for _, p in asks]))
                    mark = lambda x, own: x & (TOP ^ OWN) | np.where(np.isin(x, own), OWN, _U(0))
                    rare_all, pairs_all = mark(rare_all, rare[0]), mark(pairs_all, pairs[0])
                    wide = sketch(tokens)
                    short = np.bitwise_xor.reduce(wide.reshape(-1, SKETCH), axis=0)
                    own = (n, n - int(np.count_nonzero(known)), *short.tolist(), wide if len(wide) > SKETCH else None, rare_all.tobytes(), pairs_all.view(np.int64))
                    for column, value in zip(rows, own, strict=True):
                        column.append(value)
                none = np.array([not len(t) for t in found])
                rows[2:2] = [pa.array(x, pa.int64(), mask=none) for x in (names, checks)]
                own = batch.slice(first, len(offsets) - 1)
                arrays = [own.column(0), *[c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(rows, _SET_FIELDS[1:-1], strict=True)], own.column(2)]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in _SET_FIELDS])
            give_back()

    ddl = "doc_id long, n int, odd int, sid long, check long, " + ", ".join(f"b{k} long" for k in range(SKETCH)) + ", wide array<long>, rare binary, pairs array<long>, text_key long"
    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, ddl)


def _rare_entries(sets: DataFrame) -> DataFrame:
    """(entry, sid, own) of rare tokens for the entries where at least two different sets are.

    Such an entry has few sets, and most have one: they are packed like counted keys.
    """
    bits, dtypes = range_bits(sets), [np.int64]

    def merge(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys)
        return keys[order], [np.concatenate([x[0] for _, x in held])[order]]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for sid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw:
                    own = np.frombuffer(raw, dtype=_U)
                    held.append((own, [np.full(len(own), sid, dtype=np.int64)]))
                    n += len(own)
                if n >= FLUSH_KEYS:
                    yield spread(*merge(held), first_bits(bits))
                    held, n = [], 0
                    give_back()
        if n:
            yield spread(*merge(held), first_bits(bits))
        give_back()

    def reduced(group: pa.Table) -> pa.Table:
        held = [unpack(blob, n, dtypes) for blob, n in zip(group["blob"].to_pylist(), group["n"].to_pylist(), strict=True)]
        keys, sids = np.concatenate([k for k, _ in held]), np.concatenate([x[0] for _, x in held])
        del held
        order = np.lexsort((keys, sids, keys & ~OWN))
        keys, sids = keys[order], sids[order]
        entry = keys & ~OWN
        # of a set that is there twice, the row that says it is indexed is the last
        last = np.concatenate([(entry[1:] != entry[:-1]) | (sids[1:] != sids[:-1]), [True]])
        entry, sids, own = entry[last], sids[last], (keys[last] & OWN) == OWN
        start = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        size = np.diff(np.append(start, len(entry)))
        indexed = np.add.reduceat(own.astype(np.int64), start)
        keep = np.repeat((size > 1) & (indexed > 0), size)
        found = pa.table([pa.array(entry[keep].view(np.int64)), pa.array(sids[keep]), pa.array(own[keep])], ["entry", "sid", "own"])
        del keys, sids, entry, order, last
        give_back()
        return found

    packed = cut_again(sets.where("sid is not null").select("sid", "rare").mapInArrow(mapped, RANGE), bits, sets.rdd.getNumPartitions(), dtypes, merge)
    return packed.groupBy("r").applyInArrow(reduced, "entry long, sid long, own boolean")


def _pair_entries(sets: DataFrame) -> DataFrame:
    """The same for pairs of frequent tokens, whose entries may have any number of sets."""
    spread = sets.where("sid is not null").select("sid", F.explode("pairs").alias("_key"))
    own = F.lit(int(OWN))
    entry = F.col("_key").bitwiseAND(F.lit(~int(OWN)))
    rows = spread.groupBy(entry.alias("entry"), "sid").agg(F.bool_or(F.col("_key").bitwiseAND(own) == own).alias("own"))
    return rows.select((F.col("entry") + 1).alias("entry"), "sid", "own")  # never equal to one of rare tokens


def _torn(sets: DataFrame) -> DataFrame | None:
    """(sid, first): the names of two sets that differ in their second hash, and the one that keeps it; None as good as always."""
    checks = sets.where("sid is not null").groupBy("sid").agg(F.min("check").alias("first"), F.max("check").alias("_last"))
    torn = cut(checks.where("first != _last").select("sid", "first"))
    return torn if torn.head(1) else None


def _told_apart(named: DataFrame, torn: DataFrame | None) -> DataFrame:
    """Rows with sid and check, under new names where sets of one name differ."""
    if torn is None:
        return named
    own = F.when(F.col("check").isNull() | (F.col("check") == F.coalesce("first", "check")), F.col("sid")).otherwise(F.xxhash64("sid", "check"))
    return named.join(torn, "sid", "left").withColumn("sid", own).select(*named.columns)


def _folded(wide: Column, size: Column) -> Column:
    """A parity sketch folded to so many longs."""
    parts = F.sequence(F.lit(0), (F.size(wide) / size).cast("int") - 1)
    return F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), size), lambda a, k: F.zip_with(a, F.slice(wide, k * size + 1, size), lambda x, y: x.bitwiseXOR(y)))


def _sketched(pairs: DataFrame, sets: DataFrame, s: Similarity) -> DataFrame:
    """The pairs that their sketches of about a bit a token allow to be similar: (u, v, sizes nu and nv, further columns)."""
    pairs = cut(pairs)
    asked = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    wides = sets.where("wide is not null").select("sid", "wide").join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("wide").alias("wide"))
    both = pairs.join(wides.select(F.col("sid").alias("u"), F.col("wide").alias("_a")), "u", "left").join(wides.select(F.col("sid").alias("v"), F.col("wide").alias("_b")), "v", "left")
    size = F.least(F.size("_a"), F.size("_b"))
    odd = F.aggregate(F.zip_with(_folded(F.col("_a"), size), _folded(F.col("_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    total = F.col("nu") + F.col("nv")
    allowed = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), odd <= total - 2 * s.overlap(total)).otherwise(F.lit(True))
    return both.where(allowed).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, torn: DataFrame | None, documents: DataFrame, s: Similarity) -> DataFrame:
    """Those of the pairs (set names u and v, further columns) that are similar, by whole sets."""
    pairs = cut(_sketched(pairs, sets, s))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    texts = cut(sets.where("sid is not null").select("sid", "text_key").join(nodes, "sid", "left_semi").groupBy("sid").agg(F.min("text_key").alias("key")).select("key"))
    wanted = bloom.only(documents.select("text", F.xxhash64("text").alias("key")), texts, "key").select("text")
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # one more copy of a set that this task has sent on tells nothing
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                found = list(shingle_sets(Words(data, offsets), s.words))
                names = list(zip(*(x.tolist() for x in set_names(found)), strict=True))
                new = [k for k, x in enumerate(names) if x not in seen and not seen.add(x)]
                again = list(shingle_sets(Words(data, offsets, seed=1), s.words))
                for part in (new[k : k + 64] for k in range(0, len(new), 64)):
                    lists = [pa.array([x[k].view(np.int64) for k in part], pa.list_(pa.int64())) for x in (found, again)]
                    yield pa.RecordBatch.from_arrays([pa.array([names[k][j] for k in part], pa.int64()) for j in (0, 1)] + lists, ["sid", "check", "a", "b"])
            give_back()

    held = wanted.mapInArrow(run, "sid long, check long, a array<long>, b array<long>")
    whole = _told_apart(held, torn).groupBy("sid").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    sides = [whole.select(F.col("sid").alias(c), F.col("a").alias(f"{c}a"), F.col("b").alias(f"{c}b")) for c in ("u", "v")]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    alike = lambda c: F.size(F.array_intersect(f"u{c}", f"v{c}")) >= s.overlap(F.size(f"u{c}") + F.size(f"v{c}"))
    return both.where(alike("a") & alike("b")).select(*pairs.columns)


def _may_link(s: Similarity, x: str, y: str) -> Column:
    """Whether sizes and sketches of two sets allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "n") + c(y, "n")
    odd = sum((F.bit_count(c(x, f"b{k}").bitwiseXOR(c(y, f"b{k}"))) for k in range(SKETCH)), F.lit(0))
    sizes = F.least(c(x, "n"), c(y, "n")) * s.den >= F.greatest(c(x, "n"), c(y, "n")) * s.num
    return sizes & (odd <= total - 2 * s.overlap(total))


def _node(name: str, doc: str) -> Column:
    """A set as a node of the graph of links: ordered by its least doc_id, sets without one last."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(name).alias("sid"))


def _components(links: DataFrame) -> DataFrame:
    """(sid, component) of linked sets: the component is the node of the least doc_id in it."""
    tied = connected(links.select(_node("u", "udoc").alias("u"), _node("v", "vdoc").alias("v")))
    return tied.select(F.col("node.sid").alias("sid"), "component")


def near_duplicates(documents: DataFrame, s: Similarity) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) for each row of documents."""
    if not isinstance(documents.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys, counts, _ = frequent_tokens(docs, s)
    sets = stored(_sets(docs, s, keys, counts))
    torn = _torn(sets)
    sets = sets if torn is None else stored(_told_apart(sets, torn))
    bits = [f"b{k}" for k in range(SKETCH)]
    nodes = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "odd", *bits)])
    # the entries with more than one set
    entries = stored(_rare_entries(sets).unionAll(_pair_entries(sets)))
    shared = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("m"), F.bool_or("own").alias("any")).where("m > 1 and any").select("entry")
    members = stored(entries.join(shared, "entry").join(nodes.select("sid", "n", "odd"), "sid"))
    # first every member with the least changed one of its entry
    hubs = members.groupBy("entry").agg(F.min(F.struct("odd", "sid")).alias("_h")).select("entry", F.col("_h.sid").alias("hub"))
    ties = members.join(hubs, "entry").where("sid != hub").select(F.col("sid").alias("u"), F.col("hub").alias("v")).distinct()
    ties = ties.join(nodes.alias("x"), F.col("x.sid") == F.col("u")).join(nodes.alias("y"), F.col("y.sid") == F.col("v")).where(_may_link(s, "x", "y"))
    ends = [F.col(f"{side}.{c}").alias(f"{kind}{end}" if kind else f"{end}{c}") for side, end in (("x", "u"), ("y", "v")) for kind, c in (("n", "n"), ("", "doc"))]
    links = cut(_verified(ties.select("u", "v", *ends), sets, torn, docs, s))
    found = cut(_components(links))
    # then members in different components; a set without links is one for itself
    placed = members.join(found.select("sid", F.col("component.sid").alias("component")), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = stored(placed)
    sizes = placed.groupBy("entry", "component").agg(F.count(F.lit(1)).alias("m"))
    split = sizes.groupBy("entry").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("m", "component")).alias("main")).where("parts > 1")
    apart = placed.join(split.select("entry", "main"), "entry").join(nodes.select("sid", "doc", *bits), "sid")
    x, y = apart.where("component != main").alias("x"), apart.alias("y")
    different = (F.col("x.entry") == F.col("y.entry")) & (F.col("x.component") != F.col("y.component"))
    # two members outside the main component meet once; the shorter set must be indexed there
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
    indexed = (F.col("x.own") & (F.col("x.n") <= F.col("y.n"))) | (F.col("y.own") & (F.col("y.n") <= F.col("x.n")))
    both = x.join(y, different & once & indexed & _may_link(s, "x", "y")).select(F.col("x.sid").alias("u"), F.col("y.sid").alias("v"), *ends)
    turned = both.where("u > v").select(*[F.col(a).alias(b) for a, b in (("u", "v"), ("v", "u"), ("nu", "nv"), ("nv", "nu"), ("udoc", "vdoc"), ("vdoc", "udoc"))])
    late = both.where("u < v").unionByName(turned).distinct()
    more = cut(_verified(late, sets, torn, docs, s))
    if more.head(1):
        # only components are left to be tied, by what the late links say of them
        name = lambda c: found.select(F.col("sid").alias(c), F.col("component").alias(f"{c}c"))
        ties = more.join(name("u"), "u", "left").join(name("v"), "v", "left")
        joined = cut(connected(ties.select(F.coalesce("uc", _node("u", "udoc")).alias("u"), F.coalesce("vc", _node("v", "vdoc")).alias("v"))))
        onto = joined.select(F.col("node.sid").alias("_of"), F.col("component").alias("_onto"))
        moved = found.join(onto, F.col("component.sid") == F.col("_of"), "left").select("sid", F.coalesce("_onto", "component").alias("component"))
        alone = onto.select(F.col("_of").alias("sid"), F.col("_onto").alias("component")).join(found, "sid", "left_anti")
        found = cut(moved.unionAll(alone))
    # a set of several documents or with links is named by the least of them, one that is neither by its own
    tied = found.select("sid", F.col("component.doc").alias("_doc"), F.lit(True).alias("_tied"))
    named = nodes.select("sid", "doc", "copies").join(tied, "sid", "left").where("copies > 1 or _tied")
    named = cut(named.select("sid", F.when(F.col("_tied"), F.col("_doc")).otherwise(F.col("doc")).alias("_least"), F.lit(True).alias("_named")))
    # a table of so many rows goes to every task, so that the documents need not be dealt by their sets
    named = F.broadcast(named) if named.count() <= MAX_NAMED else named
    return sets.select("doc_id", "n", "sid").join(named, "sid", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("_named"), F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
