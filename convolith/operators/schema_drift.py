"""Schemas that drift between the files of a feed.

Every top-level key of the JSON objects of a file is profiled: its type, a histogram of the shapes of
its values, a bottom-k sketch of the hashed tokens in them, and its numeric range.  Between one file
of a feed and the next, the keys that are gone and the keys that are new form a bipartite graph whose
edges join keys of one type.  An edge's weight is the likeness of shapes, tokens or ranges and names,
and, where records were exported again by the later file, how many of them carry the same value under
both keys.  A maximum-weight matching (Hungarian method) of each boundary gives the renames.

Only profiles are ever gathered: their number is the number of keys, their size is bounded, and they
are built with map-side aggregation, so a feed that holds a third of all rows is no obstacle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolith.operators.hierarchy import hierarchies
from convolith.shared import materialise

SKETCH = 64  # hashes kept of a key's tokens
SHAPES = 64  # hashes kept of the shapes of a key's values, whole values being hashed; with more, likeness is an estimate over all
ACCEPT = 0.5  # least weight of a rename
KINDS = ("string", "integer", "decimal", "boolean", "array", "object")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def exploded(df: DataFrame, feed: str, file_no: str, row_no: str, record: str, json: str) -> DataFrame:
    """One row for each top-level key of each record: feed, file_no, row_no, record, key, kind, value.

    ``kind`` is string, integer, decimal, boolean, array or object, null for a JSON null; ``value`` is
    the value as text.  Text that is no JSON object (or repeats a key) and null text have no keys.
    """
    rows = df.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(row_no).alias("row_no"), F.col(record).alias("record"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    spark = df.sparkSession
    keys = spark.sql("select r.feed, r.file_no, r.row_no, r.record, e.key, schema_of_variant(e.value) as k, e.value from {r} r, lateral variant_explode(r.v) e", r=rows)
    kind = F.when(F.col("k") == "STRING", "string").when(F.col("k") == "BOOLEAN", "boolean").when(F.col("k") == "BIGINT", "integer")
    # an integer literal that fits is a BIGINT, so a short decimal without places was written as 1.0
    kind = kind.when(F.col("k").rlike("^DECIMAL\\((19|[23]\\d),0\\)$"), "integer").when(F.col("k").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
    kind = kind.when(F.startswith("k", F.lit("ARRAY")), "array").when(F.startswith("k", F.lit("OBJECT")), "object")
    text = F.when(F.col("k") == "STRING", F.expr("cast(value as string)")).otherwise(F.to_json("value"))
    return keys.select("feed", "file_no", "row_no", "record", "key", kind.alias("kind"), F.when(F.col("k") != "VOID", text).alias("value"))


def _shape(kind: Column, value: Column) -> Column:
    """Of the whole value: letters to a, digits to 9, runs collapsed; of numbers, the decimals or the magnitude."""
    text = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\d+", "9")
    text = F.regexp_replace(text, r'"?a"?([,; ]+"?a"?)+', "a+")
    number = F.when(kind == "decimal", F.length(F.regexp_replace(value, r"^[^.]*\.?", "")).cast("string")).otherwise(F.length(value).cast("string"))
    return F.when(kind.isin("integer", "decimal"), number).otherwise(text)


def _kind_counts(n: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"n_{k}") for k in KINDS]


def _main_kind() -> Column:
    """The kind of most values by the columns n_*; integers among decimals are decimals."""
    best, kind = F.greatest(*[F.col(f"n_{k}") for k in sorted(KINDS)]), F.lit(None).cast("string")
    for k in ("string", "object", "integer", "decimal", "boolean", "array"):
        kind = F.when((F.col(f"n_{k}") == best) & (best > 0), k).otherwise(kind)
    return F.when((kind == "integer") & (F.col("n_decimal") > 0), "decimal").otherwise(kind)


def profiles(keys: DataFrame) -> DataFrame:
    """One row for each (feed, file_no, key): n, kind, shapes, tokens, low, high; sizes are bounded."""
    at = ["feed", "file_no", "key"]
    shape = keys.groupBy(*at, F.xxhash64("kind", _shape(F.col("kind"), F.col("value"))).alias("shape"), "kind").agg(F.count("*").alias("n"), F.expr("min(try_cast(value as double))").alias("low"), F.expr("max(try_cast(value as double))").alias("high"))
    ranked = shape.withColumn("r", F.row_number().over(Window.partitionBy(*at).orderBy(F.col("kind").isNull(), "shape", "kind")))
    # integers among decimals are decimals; other mixtures are settled by number, then by name
    base = ranked.groupBy(*at).agg(
        F.sum("n").alias("n"),
        *_kind_counts(F.col("n")),
        F.map_from_entries(F.collect_list(F.when((F.col("r") <= SHAPES) & F.col("kind").isNotNull(), F.struct("shape", "n")))).alias("shapes"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    base = base.select(*at, "n", _main_kind().alias("kind"), "shapes", "low", "high")
    token = keys.where("kind in ('string', 'array', 'object', 'boolean')").select(*at, F.explode(F.array_distinct(F.split(F.lower("value"), r"[^\p{L}\p{N}]+"))).alias("t")).where("t <> ''")
    hashed = token.select(*at, F.xxhash64("t").alias("h")).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*at).orderBy("h"))).where(F.col("r") <= SKETCH)
    sketch = hashed.groupBy(*at).agg(F.sort_array(F.collect_list("h")).alias("tokens"))
    return base.join(sketch, at, "left")


def _name_parts(name: str) -> set[str]:
    words = re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())
    joined = "_".join(words)
    return {joined[i : i + 3] for i in range(max(1, len(joined) - 2))} | set(words)


def likeness(kind: str, a: dict, b: dict) -> float:
    """How alike two profiled keys of one kind are, 0 to 1: shapes, tokens or ranges, names."""
    pa, pb = a["shapes"] or {}, b["shapes"] or {}
    full = [max(p) for p in (pa, pb) if len(p) >= SHAPES]
    if full:  # of sketches that are full, the part both cover, as in a bottom-k estimate
        pa, pb = ({k: n for k, n in p.items() if k <= min(full)} for p in (pa, pb))
    na, nb = sum(pa.values()) or 1, sum(pb.values()) or 1
    shape = sum(min(pa.get(k, 0) / na, pb.get(k, 0) / nb) for k in pa.keys() | pb.keys())
    if kind in ("integer", "decimal"):
        lo, hi = min(a["low"], b["low"]), max(a["high"], b["high"])
        content = 1.0 if hi <= lo else max(0.0, min(a["high"], b["high"]) - max(a["low"], b["low"])) / (hi - lo)
    else:
        ta, tb = set(a["tokens"] or ()), set(b["tokens"] or ())
        if ta and tb and max(len(ta), len(tb)) >= SKETCH:  # bottom-k estimate
            low = sorted(ta | tb)[:SKETCH]
            content = sum(h in ta and h in tb for h in low) / len(low)
        else:
            content = len(ta & tb) / max(1, min(len(ta), len(tb)))
    na_, nb_ = _name_parts(a["key"]), _name_parts(b["key"])
    return 0.45 * shape + 0.45 * content + 0.10 * len(na_ & nb_) / len(na_ | nb_)


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight bipartite matching; the Hungarian method with potentials."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in pairs] if flip else pairs


def _match_boundary(pdf: pd.DataFrame) -> pd.DataFrame:
    gone, new = sorted(set(pdf["old_key"])), sorted(set(pdf["new_key"]))
    weight = np.zeros((len(gone), len(new)))
    for r in pdf.to_dict("records"):
        a = {"key": r["old_key"], "shapes": dict(r["old_shapes"] or {}), "tokens": r["old_tokens"] if r["old_tokens"] is not None else (), "low": r["old_low"], "high": r["old_high"]}
        b = {"key": r["new_key"], "shapes": dict(r["new_shapes"] or {}), "tokens": r["new_tokens"] if r["new_tokens"] is not None else (), "low": r["new_low"], "high": r["new_high"]}
        a["tokens"], b["tokens"] = list(a["tokens"]), list(b["tokens"])
        w = likeness(r["kind"], a, b)
        if r["n_shared"] > 0:
            w = 0.25 * w + 0.75 * r["n_same"] / r["n_shared"]
        weight[gone.index(r["old_key"]), new.index(r["new_key"])] = w
    found = [(gone[i], new[j]) for i, j in best_matching(weight) if weight[i, j] >= ACCEPT]
    return pd.DataFrame([(pdf["feed"].iloc[0], pdf["file_no"].iloc[0], a, b) for a, b in found], columns=["feed", "file_no", "old_key", "new_key"], dtype=object)


def schema_changes(df: DataFrame, feed: str = "feed", file_no: str = "file_no", row_no: str = "input_no", record: str = "id", json: str = "metadata") -> DataFrame:
    """feed, file_no, change_type, field_name, to_name: all changes of keys from each file to the next.

    Defined cases: rows with a null feed or file number belong to no file; null, empty or malformed
    JSON has no keys, yet its file exists; a key whose values are all null has no type, so it can be
    added or removed but neither renamed nor retyped; repeated rows count once for each repetition and
    change nothing; of equally good matchings the one of the lesser names is taken; an empty table
    gives an empty result; extra columns are ignored.
    """
    df = df.where(F.col(feed).isNotNull() & F.col(file_no).isNotNull())
    keys = materialise(exploded(df, feed, file_no, row_no, record, json), "keys")
    profile = materialise(profiles(keys), "profiles")
    files = df.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no")).distinct()
    steps = files.withColumn("prev_no", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no")))
    later = steps.where("prev_no is not null")
    cols = ["kind", "shapes", "tokens", "low", "high"]
    old = profile.join(later.withColumnRenamed("file_no", "next_no").withColumnRenamed("prev_no", "file_no"), ["feed", "file_no"]).select("feed", F.col("next_no").alias("file_no"), "key", *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(1).alias("in_old"))
    new = profile.join(later.select("feed", "file_no"), ["feed", "file_no"]).select("feed", "file_no", "key", *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(1).alias("in_new"))
    both = materialise(old.join(new, ["feed", "file_no", "key"], "full"), "both")
    retyped = both.where("old_kind <> new_kind").select("feed", "file_no", F.lit("retyped").alias("change_type"), F.col("key").alias("field_name"), F.col("new_kind").alias("to_name"))
    gone, fresh = both.where("in_new is null"), both.where("in_old is null")
    pairs = gone.select("feed", "file_no", F.col("key").alias("old_key"), *[f"old_{c}" for c in cols]).join(fresh.select("feed", "file_no", F.col("key").alias("new_key"), *[f"new_{c}" for c in cols]), ["feed", "file_no"]).where("old_kind = new_kind").withColumnRenamed("old_kind", "kind").drop("new_kind")
    pairs = materialise(pairs, "pairs")
    edges = pairs.select("feed", "file_no", "old_key", "new_key").join(later, ["feed", "file_no"])
    value = keys.where("value is not null and record is not null").select("feed", "file_no", "record", "key", "value").distinct()
    before = edges.join(value.select("feed", F.col("file_no").alias("prev_no"), F.col("key").alias("old_key"), "record", F.col("value").alias("old_value")), ["feed", "prev_no", "old_key"])
    shared = before.join(value.select("feed", "file_no", F.col("key").alias("new_key"), "record", F.col("value").alias("new_value")), ["feed", "file_no", "new_key", "record"])
    shared = shared.groupBy("feed", "file_no", "old_key", "new_key").agg(F.count("*").alias("n_shared"), F.sum((F.col("old_value") == F.col("new_value")).cast("long")).alias("n_same"))
    scored = pairs.join(shared, ["feed", "file_no", "old_key", "new_key"], "left").fillna(0, ["n_shared", "n_same"])
    # one group holds the gone and new keys of one boundary, never rows of the table
    feed_type, no_type = dict(df.dtypes)[feed], dict(df.dtypes)[file_no]
    renames = materialise(scored.groupBy("feed", "file_no").applyInPandas(_match_boundary, f"feed {feed_type}, file_no {no_type}, old_key string, new_key string"), "renames")
    out = renames.select("feed", "file_no", F.lit("renamed").alias("change_type"), F.col("old_key").alias("field_name"), F.col("new_key").alias("to_name"))
    removed = gone.join(renames.select("feed", "file_no", F.col("old_key").alias("key")), ["feed", "file_no", "key"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change_type"), F.col("key").alias("field_name"), F.lit("").alias("to_name"))
    added = fresh.join(renames.select("feed", "file_no", F.col("new_key").alias("key")), ["feed", "file_no", "key"], "left_anti").select("feed", "file_no", F.lit("added").alias("change_type"), F.col("key").alias("field_name"), F.lit("").alias("to_name"))
    return out.unionByName(removed).unionByName(added).unionByName(retyped)


def unified_table(df: DataFrame, changes: DataFrame, feed: str = "feed", file_no: str = "file_no", row_no: str = "input_no", record: str = "id", json: str = "metadata") -> DataFrame:
    """One consistent long table: each key under the last name it bears in its feed, its value as text.

    Returns row_no, feed, file_no, record, field, key, kind, value.  A rename is followed to the next
    rename of the name it leads to; chains of renames are resolved with the hierarchy operator.
    """
    keys = exploded(df, feed, file_no, row_no, record, json)
    moves = changes.where("change_type = 'renamed'").select("feed", "file_no", F.col("field_name").alias("a"), F.col("to_name").alias("b")).withColumn("node", F.concat_ws("@", F.col("file_no").cast("string"), "a"))
    nxt = moves.select("feed", F.col("file_no").alias("nf"), F.col("a").alias("b"), F.col("node").alias("nn"))
    chain = moves.join(nxt, ["feed", "b"], "left").where("nf is null or nf > file_no").groupBy("feed", "node", "b").agg(F.min_by("nn", "nf").alias("up"))
    lost = moves.join(chain.select("feed", "node"), ["feed", "node"], "left_anti").select("feed", "node", "b", F.lit(None).cast("string").alias("up"))
    chain = chain.unionByName(lost)
    top = hierarchies(chain, "feed", "node", "up").select("feed", F.col("id").alias("node"), F.col("root_id"))
    last = chain.select("feed", F.col("node").alias("root_id"), F.col("b").alias("field"))
    names = moves.select("feed", F.col("file_no").alias("move_no"), F.col("a").alias("key"), "node").join(top, ["feed", "node"]).join(last, ["feed", "root_id"])
    names = names.withColumn("from_no", F.coalesce(F.lag("move_no").over(Window.partitionBy("feed", "key").orderBy("move_no")), F.lit(-(2**31)))).select("feed", "key", "from_no", "move_no", "field")
    at = (keys["feed"] == names["feed"]) & (keys["key"] == names["key"]) & (keys["file_no"] < names["move_no"]) & (keys["file_no"] >= names["from_no"])
    return keys.join(names, at, "left").select(keys["row_no"], keys["feed"], keys["file_no"], keys["record"], F.coalesce(names["field"], keys["key"]).alias("field"), keys["key"], keys["kind"], keys["value"])


def _plain(kind: Column, value: Column) -> Column:
    """A scalar as text: itself, the only element of an array, or the member ``value`` of an object that wraps it."""
    v = F.when(kind.isin("array", "object"), F.try_parse_json(value))
    inner = F.when((kind == "array") & F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")).when(kind == "object", F.try_variant_get(v, "$.value", "variant"))
    of = F.schema_of_variant(inner)
    inner = F.when(of == "STRING", inner.cast("string")).when(~of.rlike("^(ARRAY|OBJECT|VOID)"), F.to_json(inner))
    return F.when(kind.isin("array", "object"), inner).otherwise(value)


def _as_kind(to: Column, kind: Column, value: Column, plain: Column) -> Column:
    """``value`` as text of the kind ``to``, or null where it can't be brought to it without a guess."""
    number = F.when(plain.rlike(NUMBER), plain.try_cast("double")).when(kind == "boolean", (plain == "true").cast("double"))
    integer = F.when((number == F.rint(number)) & plain.rlike(NUMBER), F.trim(plain).try_cast("decimal(38,0)").cast("string")).when(kind == "boolean", number.cast("int").cast("string"))
    truth = F.when((F.lower(F.trim(plain)) == "true") | (number == 1), "true").when((F.lower(F.trim(plain)) == "false") | (number == 0), "false")
    items = F.from_json(F.when(F.schema_of_variant(F.when(kind == "array", F.try_parse_json(value))) == "ARRAY<STRING>", value), "array<string>")
    joined = F.when(value == "[]", "").when(~F.exists(items, lambda x: x.isNull() | x.contains(";")), F.array_join(items, ";"))
    parts = F.to_json(F.filter(F.transform(F.split(plain, ";"), lambda x: F.trim(x)), lambda x: x != ""))
    listed = F.when(kind == "array", value).when(kind.isin("integer", "decimal", "boolean"), F.concat(F.lit("["), value, F.lit("]"))).otherwise(parts)
    out = F.when(to == "string", F.when((kind == "array") & plain.isNull(), joined).otherwise(plain))
    return out.when(to == "integer", integer).when(to == "decimal", number.cast("string")).when(to == "boolean", truth).when(to == "array", listed).when((to == "object") & (kind == "object"), value)


def _alike(nodes: DataFrame) -> DataFrame:
    """a, b, weight of the pairs of names whose profiles of one kind are alike.

    The values of a boolean tell nothing across feeds, so there the names alone count.
    """
    cols = ["shapes", "tokens", "low", "high"]
    one, two = (nodes.select("kind", *[F.col(c).alias(f"{p}_{c}") for c in ("key", *cols)]) for p in "ab")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for r in pdf.to_dict("records"):
                a, b = ({"key": r[f"{p}_key"], "shapes": dict(r[f"{p}_shapes"] or {}), "tokens": () if r[f"{p}_tokens"] is None else list(r[f"{p}_tokens"]), "low": r[f"{p}_low"], "high": r[f"{p}_high"]} for p in "ab")
                na, nb = _name_parts(a["key"]), _name_parts(b["key"])
                got.append((a["key"], b["key"], len(na & nb) / max(1, len(na | nb)) if r["kind"] == "boolean" else likeness(r["kind"], a, b)))
            yield pd.DataFrame(got, columns=["a", "b", "weight"])

    pairs = one.join(two, "kind").where("a_key < b_key").mapInPandas(run, "a string, b string, weight double")
    return pairs.groupBy("a", "b").agg(F.max("weight").alias("weight")).where(F.col("weight") >= ACCEPT)


def grouped_names(names: Iterable[str], links: Iterable[tuple[str, str, float]], apart: Iterable[tuple[str, str]]) -> list[set[str]]:
    """Groups of names that stand for one field: strongest links first, never two names of ``apart`` in one group."""
    group = {n: n for n in names}
    members, barred = {n: {n} for n in group}, {n: set() for n in group}
    for a, b in apart:
        barred[a].add(b)
        barred[b].add(a)
    for a, b, _ in sorted(links, key=lambda e: (-e[2], e[0], e[1])):
        x, y = group[a], group[b]
        if x == y or barred[x] & members[y]:
            continue
        for n in members[y]:
            group[n] = x
        members[x] |= members.pop(y)
        barred[x] |= barred.pop(y)
    return list(members.values())


def consistent_table(files: DataFrame, outcome: DataFrame, changes: DataFrame) -> DataFrame:
    """One table of the keys of all feeds and of the outcome: one name and one type for each field.

    ``files`` is what unified_table gives; ``outcome`` are exploded() rows of no feed.  A key of the
    outcome takes the field that its record's latest file gives it, else its own name.  A name is one
    field in all feeds.  Names are brought together by the renames of any feed and by the likeness of
    their profiles, except names that stand side by side in a file; the field is called by its most
    frequent name and has its most frequent kind, integers with any fraction among them being decimal.

    Returns origin (files or outcome), row_no, feed, file_no, record, field, kind, value, key, raw_kind,
    raw, failed.  ``failed`` marks values that can't be brought to the field's kind: their value is
    null, ``raw`` keeps them.  A JSON null stays null and is no failure.
    """
    spark = files.sparkSession
    known = files.where("record is not null").groupBy("record", "key").agg(F.max(F.struct("file_no", "feed", "field")).alias("at")).select("record", "key", F.col("at.field").alias("field"))
    late = outcome.join(known, ["record", "key"], "left").withColumn("field", F.coalesce("field", "key")).withColumn("origin", F.lit("outcome"))
    rows = files.withColumn("origin", F.lit("files")).unionByName(late)
    rows = materialise(rows.withColumn("plain", _plain(F.col("kind"), F.col("value"))), "resolved")
    number = F.when(F.col("plain").rlike(NUMBER), F.col("plain").try_cast("double"))
    counts = {r["field"]: r.asDict() for r in rows.groupBy("field").agg(F.count("*").alias("n"), F.coalesce(F.sum((number != F.rint(number)).cast("long")), F.lit(0)).alias("n_frac"), *_kind_counts(F.lit(1))).collect()}
    # a row of no file is a file of its own
    unit = F.when((F.col("origin") == "files") & F.col("feed").isNotNull() & F.col("file_no").isNotNull(), F.to_json(F.struct("feed", "file_no"))).otherwise(F.concat_ws(" ", "origin", "row_no"))
    stands = rows.select(unit.alias("unit"), "field").distinct()
    apart = stands.withColumnRenamed("field", "a").join(stands.withColumnRenamed("field", "b"), "unit").where("a < b").select("a", "b").distinct()
    main = rows.groupBy(unit.alias("unit"), "field").agg(*_kind_counts(F.lit(1))).select("unit", "field", _main_kind().alias("main")).where("main is not null")
    nodes = rows.withColumn("unit", unit).join(main, ["unit", "field"]).where("kind = main").select(F.lit("").alias("feed"), F.col("main").alias("file_no"), F.col("field").alias("key"), "kind", "value")
    renamed = changes.where("change_type = 'renamed'").groupBy(F.col("field_name").alias("a"), F.col("to_name").alias("b")).agg((1.0 + F.count("*")).alias("weight"))
    links = [tuple(r) for r in renamed.unionByName(_alike(materialise(profiles(nodes).drop("kind").withColumnRenamed("file_no", "kind"), "nodes"))).collect()]
    names = counts.keys() | {n for a, b, _ in links for n in (a, b)}
    said = []
    for group in grouped_names(sorted(names), links, [tuple(r) for r in apart.collect()]):
        own = [counts[n] for n in sorted(group) if n in counts]
        if not own:
            continue
        field = max(own, key=lambda c: c["n"])["field"]
        total = {k: sum(c[f"n_{k}"] for c in own) for k in KINDS}
        kind = max(sorted(KINDS), key=total.get) if any(total.values()) else None
        if kind == "integer" and (total["decimal"] or sum(c["n_frac"] for c in own)):
            kind = "decimal"
        said += [(n, field, kind) for n in sorted(group)]
    called = spark.createDataFrame(said, "field string, name string, to string")
    value = _as_kind(F.col("to"), F.col("kind"), F.col("value"), F.col("plain"))
    out = rows.join(F.broadcast(called), "field").withColumn("cast", value)
    failed = F.col("value").isNotNull() & F.col("cast").isNull()
    return out.select("origin", "row_no", "feed", "file_no", "record", F.col("name").alias("field"), F.col("to").alias("kind"), F.col("cast").alias("value"), "key", F.col("kind").alias("raw_kind"), F.col("value").alias("raw"), failed.alias("failed"))
