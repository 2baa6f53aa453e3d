"""Line removal by an exact set-similarity join (operator 7), in DataFrame functions only.

A line's tokens are its distinct five-word shingles (a shorter line is one token).
A line goes if an earlier one, by doc_id and place, has a Jaccard similarity of
``similarity`` or more.

Equal lines are collapsed first.  A line of k tokens has no similar one if
k - ceil(t k) + 1 of its tokens stand in no other line.  Four-word parts of tokens
whose first two words hash into the first ``CLASS`` of 1024 parts are counted exactly
over all lines.  What occurs once makes both tokens that hold it lonely, so that half
as many rows show as many lonely tokens; a line that shows enough of them leaves before
anything else is made of it.

The tokens of the lines that stay are ordered by rarity: counts in ``RANKS`` hash
buckets, the rarest bucket first.  Similar lines share a token among their first
k - ceil(t k) + 1; the join on those prefixes passes pairs that the length and
positional filters allow, and each pair is verified on hashes of the shingles, then
on their words.  A token that many lines share is joined in two steps, so that no
list of lines is paired out without need: every line is first tried against the
earliest line of each of its tokens, and only lines that this does not decide meet
the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import col, release, save

SHINGLE, SIMILARITY = 5, 0.8
#: Parts in 1024 of all four-word parts that are counted one by one.
CLASS = 205
#: Buckets of the rarity counts.
RANK_BITS = 16
RANKS = 1 << RANK_BITS
#: Keys (of eight bytes) that a join may broadcast.
BROADCAST_KEYS = 2_000_000


def spaced(line: str) -> str:
    """SQL for a line whose white space is spaces; most lines have no other and stay as they are."""
    others = " OR ".join(f"contains({line}, '{c}')" for c in ("\\u0009", "\\u000B", "\\u000C", "\\u000D"))
    return f"IF({others}, translate({line}, '\\u0009\\u000B\\u000C\\u000D', '    '), {line})"


def words(line: str) -> str:
    """SQL for the words of a line whose white space is spaces."""
    return f"array_remove(split({line}, ' ', -1), '')"


def shingles(w: str, size: int = SHINGLE) -> str:
    """SQL for the distinct shingles of a word array, as text; a short line is one."""
    return f"CASE WHEN size({w}) >= {size} THEN array_distinct(transform(sequence(1, size({w}) - {size - 1}), i -> array_join(slice({w}, i, {size}), ' '))) WHEN size({w}) > 0 THEN array(array_join({w}, ' ')) ELSE array() END"


def made(rows: DataFrame, keep: list[str], **columns: str) -> DataFrame:
    """``keep`` and new columns by SQL, each evaluated once.

    A generator of one row stands between: the optimizer moves no filter and no
    later expression into what it makes, which would evaluate arrays anew for
    every use of an element.
    """
    fields = ", ".join(f"'{n}', {e}" for n, e in columns.items())
    return rows.selectExpr(*keep, f"inline(array(named_struct({fields}))) AS ({', '.join(columns)})")


def with_tokens(rows: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """``keep`` and ``tokens``: hashes of the distinct shingles of the words ``w``; a short line has one.

    Each word is hashed once; a shingle's hash is the sum, without carries, of its
    words' hashes, each moved by its place.
    """
    rows = made(rows, keep, h="transform(w, x -> xxhash64(x))").withColumn("g", F.col("h"))
    length = 1
    for bit in f"{size:b}"[1:]:  # sums of twice as many words, then of one more
        places = f"greatest(size(g) - {length}, 0)"
        rows = made(rows, [*keep, "h"], g=f"zip_with(slice(g, 1, {places}), slice(g, {length + 1}, {places}), (a, b) -> shiftleft(a, {length}) ^ b)")
        length *= 2
        if bit == "1":
            places = f"greatest(size(h) - {length}, 0)"
            rows = made(rows, [*keep, "h"], g=f"zip_with(slice(g, 1, {places}), slice(h, {length + 1}, {places}), (a, b) -> shiftleft(a, 1) ^ b)")
            length += 1
    return rows.selectExpr(*keep, f"IF(size(h) < {size}, array(xxhash64(h)), array_distinct(g)) AS tokens")


def _within(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is among ``keys`` (one column, distinct): a broadcast up to
    ``BROADCAST_KEYS`` of them, which are counted first, else a join by key."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, name, "left_semi")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("mark"), col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


_KEY = ["h1", "h2", "size"]


def _keyed(texts: DataFrame) -> DataFrame:
    """Every line's place, whether it is blank, a key of 160 bits for its text, and the text."""
    lines = texts.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    blank = F.expr("length(trim(BOTH ' \\u0009\\u000A\\u000B\\u000C\\u000D' FROM line)) = 0")
    return lines.select("id", "mark", "no", blank.alias("blank"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.length("line").alias("size"), "line")


def _first_lines(texts: DataFrame) -> DataFrame:
    """Rows (key, node, first, line): every distinct line and its first place; white space is spaces."""
    least = _keyed(texts).groupBy(*_KEY).agg(F.min(F.struct("id", "mark", "no", "line")).alias("least"))
    first = F.struct(*[F.col(f"least.{x}").alias(x) for x in ("id", "mark", "no")]).alias("first")
    return least.select(*_KEY, F.monotonically_increasing_id().alias("node"), first, F.col("least.line").alias("line")).withColumn("line", F.expr(spaced("line")))


def _counted(distinct: DataFrame, size: int) -> DataFrame:
    """Rows (node, n, gain, part) for the places of counted parts of tokens; a line may have none.

    A part is a token without its last word (whole, if of two words or less) and
    stands in the tokens of its own place and the place before; ``gain`` is how many
    of these no counted part after it stands in.  ``n`` counts a line's tokens by
    places: the distinct ones are as many at most.  All is generated code; a part is
    hashed whole only if its first two words are in the class.
    """
    part = size - 1 if size > 2 else size
    w = made(distinct, ["node"], w=words("line")).where("size(w) > 0")
    places = w.selectExpr("node", "w", f"greatest(size(w) - {size - 1}, 1) AS n", f"explode(sequence(0, IF(size(w) < {size}, 0, size(w) - {part}))) AS i")
    counted = lambda i: f"((xxhash64({', '.join(f'w[{i} + {k}]' for k in range(min(2, part)))}) & 1023) < {CLASS})"
    rows = places.where(f"size(w) < {size} OR {counted('i')}")
    gain = f"IF(i > 0, 1, 0) + IF(i < n, IF({counted('i + 1')}, 0, 1), 0)" if part < size else "1"
    gram = f"xxhash64({', '.join(f'w[i + {k}]' for k in range(part))})"
    return rows.selectExpr("node", "n", f"IF(size(w) < {size}, 1, {gain}) AS gain", f"IF(size(w) < {size}, xxhash64(w), {gram}) AS part")


def _undecided(distinct: DataFrame, size: int, similarity: float) -> DataFrame:
    """The nodes of lines that may have a similar one (see above).

    Tokens around parts that occur once in all lines are lonely and differ from each other.
    """
    held = save(_counted(distinct, size), "counted-parts", ("part",))
    repeated = save(held.groupBy("part").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("part"), "repeated-parts", ("part",))
    alone = held.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated, "part", "left_anti")
    enough = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1  # never shrinks with n
    decided = alone.groupBy("node").agg(F.max("n").alias("n"), F.sum("gain").alias("alone")).where(F.col("alone") >= enough)
    out = save(distinct.select("node").join(decided.select("node"), "node", "left_anti"), "undecided-lines")
    release(held, repeated)
    return out


def _ranks(tokens: DataFrame) -> Column:
    """An array of RANKS numbers: for each bucket of token hashes its place, the rarest first, from -RANKS / 2 on."""
    counts = tokens.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(RANKS - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = tokens.sparkSession.range(RANKS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["n"])
    placed = F.array_sort(F.collect_list(F.struct("n", "bucket"))).alias("sorted")
    ranked = every.agg(placed).select(F.posexplode("sorted").alias("rank", "held"))
    signed = F.struct("held.bucket", (F.col("rank") - RANKS // 2).alias("rank"))
    return ranked.agg(F.array_sort(F.collect_list(signed)).alias("r")).select(F.col("r.rank")).scalar()


def _prefixes(tokens: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, id, k, pos, token): the rarest tokens of every line, as many as the similarity needs.

    A token here is its rank, then the rest of its hash: one to one with the token.
    """
    rows = tokens.withColumn("ranks", _ranks(tokens))
    ranked = F.transform("tokens", lambda t: F.shiftleft(F.get(F.col("ranks"), t.bitwiseAND(RANKS - 1).cast("int")).cast("long"), 64 - RANK_BITS).bitwiseOR(F.shiftrightunsigned(t, RANK_BITS)))
    sorted_ = made(rows.select("node", F.col("first.id").alias("id"), F.size("tokens").alias("k"), F.sort_array(ranked).alias("sorted")), ["node", "id", "k"], sorted="sorted")
    prefix = F.expr(f"slice(sorted, 1, k - CAST(ceil({similarity} * k - 1e-9) AS INT) + 1)")
    return sorted_.select("node", "id", "k", F.posexplode(prefix).alias("pos", "token"))


def _alike(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows whose token arrays xt and yt are similar."""
    rows = made(rows, [c for c in rows.columns if c not in ("xt", "yt")], common="size(array_intersect(xt, yt))", total="size(xt) + size(yt)")
    return rows.where(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).drop("common", "total")


def _verified(pairs: DataFrame, near: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (x, y) of nodes the later node, where the lines are similar.

    Hashes of the shingles sort out most pairs; what they pass is verified on the
    words.  Equal hashes can only raise the first count, so nothing is lost.
    """
    side = lambda n: near.select(F.col("node").alias(n), F.col("first").alias(f"{n}_first"), F.col("line").alias(f"{n}_line"), F.col("tokens").alias(f"{n}t"))
    found = _alike(pairs.join(side("x"), "x").join(side("y"), "y"), similarity)
    names = ["x", "y", "x_first", "y_first"]
    found = made(found, names, xw=words("x_line"), yw=words("y_line"))
    found = _alike(made(found, names, xt=shingles("xw", size), yt=shingles("yw", size)), similarity)
    return found.select(F.when(F.col("x_first") < F.col("y_first"), F.col("y")).otherwise(F.col("x")).alias("node"))


def similar_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (id, mark, no, kept): a decision on every line of every text.

    ``no`` counts lines from 0; ``mark`` is the text's xxhash64 and comes between
    id and place in the order of lines.  Lines without a word are kept.  Rows
    that repeat a document (same id and text) get the same decisions, and do not
    count as earlier than each other.  Null ids and texts give no lines.
    """
    texts = _texts(docs, doc_id, text)
    distinct = save(_first_lines(texts), "distinct-lines", ("h1", "h2", "node", "line"))
    undecided = _undecided(distinct, shingle, similarity)
    near = made(_within(distinct, undecided, "node"), ["node", "first", "line"], w=words("line")).where("size(w) > 0")
    near = save(with_tokens(near, ["node", "first", "line"], shingle), "undecided-texts", ("line", "tokens.list.element"))
    postings = save(_prefixes(near, similarity), "line-prefixes")
    # the least by document: what later lines are compared with first
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "node")).alias("least")).where("n > 1").select("token", F.col("least.node").alias("least"))
    index = save(postings.join(shared, "token"), "shared-prefixes")
    release(undecided, postings)
    # Sizes within the similarity, and places of the first token that both have: before it
    # nothing is common, so what follows must hold all that is needed.
    needed = F.ceil(similarity / (1 + similarity) * (F.col("kx") + F.col("ky")) - 1e-9)
    fits = (F.least("kx", "ky") >= similarity * F.greatest("kx", "ky") - 1e-9) & (F.least(F.col("kx") - F.col("px"), F.col("ky") - F.col("py")) >= needed)
    x = index.select("token", "least", F.col("node").alias("x"), F.col("id").alias("ix"), F.col("k").alias("kx"), F.col("pos").alias("px"))
    y = index.select("token", "least", F.col("node").alias("y"), F.col("id").alias("iy"), F.col("k").alias("ky"), F.col("pos").alias("py"))
    # first, every line meets the least line of each of its tokens: at most one pair a posting
    own = x.where("x = least").drop("least")
    tried = save(y.where("y <> least").drop("least").join(own, "token").where(fits).select("x", "y").distinct(), "first-pairs")
    found = save(_verified(tried, near, shingle, similarity).distinct(), "first-matches")
    # lines that this does not decide meet every line of their tokens that is not of a later document
    still = y.join(found.withColumnRenamed("node", "y"), "y", "left_anti").drop("least")
    met = still.join(x.drop("least"), "token").where((F.col("ix") <= F.col("iy")) & (F.col("x") != F.col("y")) & fits)
    later = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    later = later.join(tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    later = save(later, "later-pairs")
    gone = found.unionByName(_verified(later, near, shingle, similarity)).distinct().select("node", F.lit(True).alias("gone"))
    judged = save(distinct.join(gone, "node", "left").select(*_KEY, "first", F.coalesce("gone", F.lit(False)).alias("gone")), "line-verdicts", ("h1", "h2"))
    release(distinct, near, index, tried, found, later)
    kept = F.col("blank") | (~F.col("gone") & (F.struct("id", "mark", "no") == F.col("first")))
    return _keyed(texts).drop("line").join(judged, _KEY).select("id", "mark", "no", kept.alias("kept"))


def remove_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that repeat an earlier one taken out of their texts.

    All columns are kept; rows with a null id or text stay as they are, and a
    text may become empty.  An empty table gives no rows.
    """
    gone = similar_lines(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity).where("NOT kept")
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.array_sort(F.collect_set("no")).alias("_gone"))
    rows = docs.select(F.struct(*[col(x) for x in docs.columns]).alias("_row"), col(doc_id).cast("long").alias("_own"), F.xxhash64(col(text)).alias("_xx"))
    joined = rows.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_xx") == F.col("_mark")), "left")
    old = F.col("_row")[text]
    new = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    return joined.select(*[(new if x == text else F.col("_row")[x]).alias(x) for x in docs.columns])
