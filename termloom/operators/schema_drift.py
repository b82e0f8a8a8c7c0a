"""Schemas that drift between files: rescue-column ingestion, and the change report read from what it rescues.

The unit is a *file*: all rows of one feed and file number of one table. Every file is ingested against the schema of
the file before it in its feed. What that schema doesn't know, or knows with another type, lands in the rescue column;
the report is made of these rescued entries and of the fields that no longer come. Into a table of typed columns the
same column takes what doesn't fit, and gives it back once its fields are approved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import checkpointed

TYPES = ("integer", "decimal", "text", "boolean", "list", "object")
#: Bins of a field's value profile for words, and as many for shapes; a profile never holds more entries than both.
BINS = 1 << 16
#: Fields whose pooled profiles have at least so many pairs of words, fewer than EQUAL of them equal, are told by shape.
PAIRS, EQUAL = 500, 10


def entries_of_json(json: Column) -> Column:
    """Top-level entries of a JSON object; null for text that is no object."""
    return F.from_json(json, "map<string,variant>")


def entries_of_fragments(fragments: Column) -> Column:
    """Entries of a map from field to JSON fragment; a fragment that is no JSON counts as text."""
    as_text = lambda v: F.variant_get(F.parse_json(F.to_json(F.struct(v.alias("v")))), "$.v", "variant")
    return F.transform_values(fragments, lambda _, v: F.coalesce(F.try_parse_json(v), as_text(v)))


def value_type(value: Column) -> Column:
    """One of TYPES, or null for null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), None)
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "decimal")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("text")
    )


def value_bins(value: Column, kind: Column) -> Column:
    """Bounded fingerprints of the kind of a value: magnitude of numbers, else the words of the text, of all of a
    list's elements or of an object's values with their keys, every digit masked, below BINS; and, from BINS on, one
    for its character classes."""
    number = F.try_variant_get(value, "$", "double")
    magnitude = F.pmod((F.signum(number) * F.round(2 * F.log2(1 + F.abs(number)))).cast("int"), F.lit(BINS))
    masked = lambda text: F.regexp_replace(F.lower(text), "[0-9]", "9")
    words = lambda text: F.regexp_extract_all(masked(text), F.lit(r"9+(?:\.9+)*|[\p{L}\p{M}\p{N}]+"), F.lit(0))
    shown = F.when(kind.isin("list", "object"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    keyed = F.flatten(F.transform(members, lambda m: F.transform(words(F.to_json(m["value"])), lambda w: F.concat(m["key"], F.lit("="), w))))
    found = F.when(kind == "object", keyed).otherwise(words(shown))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(masked(shown)))
    hashed = lambda text: F.pmod(F.xxhash64(text), F.lit(BINS)).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, r"\p{Lu}+", "A"), r"[\p{L}\p{M}&&[^A]]+", "a"), "[0-9]", "9")
    below = F.when(kind.isin("integer", "decimal"), F.array(magnitude)).otherwise(F.transform(found, hashed))
    return F.when(kind.isNull(), F.array(F.lit(BINS))).otherwise(F.concat(below, F.array(hashed(shape) + BINS)))


def _same(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """Join on left name -> right name, nulls equal."""
    on = reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in keys.items()])
    joined = left.join(right, on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[right[b] for b in keys.values()])


def file_schemas(df: DataFrame, feed: str, file_no: str, entries: Column, min_share: float = 0.1) -> DataFrame:
    """feed, file_no, seq (from 1 in the feed), n_rows, fields (field, n_held, type), own, target, following, next_file:
    one row per file, files without any entry included.

    A field counts once per row and entry, nulls included; its type is that of most of its non-null values (ties: the
    first of TYPES), null if all are null. ``own`` maps the fields that at least ``min_share`` of the rows hold to their
    types; ``target`` is the former file's, ``following`` the next file's. Rows with a null feed or file number form a
    feed or file of their own.
    """
    rows = df.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), entries.alias("entries"))
    exploded = rows.select("feed", "file_no", F.explode("entries").alias("field", "value"))
    counts = exploded.groupBy("feed", "file_no", "field", value_type(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("kind"))
    best = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", -order)))
    fields = counts.groupBy("feed", "file_no", "field").agg(F.sum("n").alias("n_held"), best.alias("type"))
    per_file = fields.groupBy(F.col("feed").alias("_feed"), F.col("file_no").alias("_file")).agg(F.collect_list(F.struct("field", "n_held", "type")).alias("fields"))
    sizes = rows.groupBy("feed", "file_no").agg(F.count("*").alias("n_rows"))
    joined = _same(sizes, per_file, {"feed": "_feed", "file_no": "_file"}, "left")
    belongs = F.filter(F.coalesce("fields", F.array().cast(per_file.schema["fields"].dataType)), lambda f: f["n_held"] >= F.col("n_rows") * F.lit(min_share))
    own = F.map_from_entries(F.transform(belongs, lambda f: F.struct(f["field"], f["type"])))
    in_order = Window.partitionBy("feed").orderBy("file_no")
    numbered = joined.withColumn("own", own).withColumn("seq", F.row_number().over(in_order))
    return numbered.select("feed", "file_no", "seq", "n_rows", "fields", "own", F.lag("own").over(in_order).alias("target"), F.lead("own").over(in_order).alias("following"), F.lead("file_no").over(in_order).alias("next_file"))


def unexpected(entries: Column, target: Column) -> Column:
    """The rescue column of a row enforced against ``target`` (map field -> type): entries of unknown fields and values
    of another type. A field whose type is not known yet takes any value."""
    return F.map_filter(entries, lambda k, v: ~F.map_contains_key(target, k) | F.coalesce(target[k] != value_type(v), F.lit(False)))


def ingest_files(df: DataFrame, feed: str, file_no: str, entries: Column, schemas: DataFrame) -> DataFrame:
    """The columns of ``schemas`` but fields, with entries and rescued of every row: each file enforced against the
    schema of the file before it; the first file of a feed sets its own."""
    rows = df.select(F.col(feed).alias("_feed"), F.col(file_no).alias("_file"), entries.alias("entries"))
    known = schemas.select("feed", "file_no", "seq", "own", F.coalesce("target", "own").alias("target"), "following", "next_file")
    joined = rows.join(known, rows["_feed"].eqNullSafe(known["feed"]) & rows["_file"].eqNullSafe(known["file_no"])).drop("_feed", "_file")
    return joined.withColumn("rescued", unexpected(F.col("entries"), F.col("target")))


def _evidence(ingested: DataFrame) -> DataFrame:
    """feed, file_no, seq, next_file, side, field, type, profile: one row per file and field that changed. ``new``: rescued
    and unknown, ``retyped``: rescued and known, ``old``: held and not in the next file. The profiles are of the values
    of the field's own type."""
    own, target, following = F.col("own"), F.col("target"), F.col("following")
    rescued = F.map_entries(F.map_filter("rescued", lambda k, _: F.map_contains_key(own, k) & ~(F.map_contains_key(target, k) & own[k].eqNullSafe(target[k]))))
    ending = F.map_entries(F.map_filter("entries", lambda k, _: F.map_contains_key(own, k) & ~F.map_contains_key(F.coalesce(following, own), k)))
    marked = F.concat(
        F.transform(rescued, lambda e: F.struct(F.when(F.map_contains_key(target, e["key"]), "retyped").otherwise("new").alias("side"), e["key"].alias("field"), e["value"].alias("value"))),
        F.transform(ending, lambda e: F.struct(F.lit("old").alias("side"), e["key"].alias("field"), e["value"].alias("value"))),
    )
    rows = ingested.select("feed", "file_no", "seq", "next_file", "own", F.inline(marked)).withColumn("type", F.col("own")[F.col("field")]).drop("own")
    kind = value_type(F.col("value"))
    of_type = rows.withColumn("kind", kind).where(F.col("kind").eqNullSafe(F.col("type")) | (F.col("side") == "retyped"))
    bins = F.when(F.col("side") == "retyped", F.array(F.lit(BINS))).otherwise(value_bins(F.col("value"), F.col("kind")))
    keys = ["feed", "file_no", "seq", "next_file", "side", "field", "type"]
    binned = of_type.select(*keys, F.explode(bins).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n"))
    return binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("profile"))


def _similarity(a: Column, b: Column, kind: Column) -> Column:
    """Likeness of two profiles: of numbers the cosine of their magnitudes; else Morisita's overlap of their words, the
    chance that a word of each is the same over that of two words of one, so neither the number of rows nor that of
    different words counts. Where words hardly repeat they tell nothing, and the shapes are compared."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    equal = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * (x - 1))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda x, y: F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + x[k] * F.coalesce(y[k], F.lit(0.0)))
    cosine = lambda x, y: F.try_divide(dot(x, y), norm(x) * norm(y))
    pairs = lambda m: total(m) * (total(m) - 1)
    # Two different words share a bin once in BINS pairs.
    repeated = lambda m: F.coalesce(F.try_divide(equal(m), pairs(m)), F.lit(0.0))
    chance = 1.0 / BINS

    def overlap(x: Column, y: Column) -> Column:
        own = (repeated(x) + repeated(y)) / 2 - chance
        return F.when(own > 0, (F.try_divide(dot(x, y), total(x) * total(y)) - chance) / own).otherwise(cosine(x, y))

    words = lambda m: F.map_filter(m, lambda k, _: k < BINS)
    shapes = lambda m: F.map_filter(m, lambda k, _: k >= BINS)
    wa, wb = words(a), words(b)
    n = (pairs(wa) + pairs(wb)) / 2
    distinct = (n >= PAIRS) & ((equal(wa) + equal(wb)) / 2 < F.greatest(F.lit(float(EQUAL)), n * (4 * chance)))
    return F.when(kind.isin("integer", "decimal"), cosine(wa, wb)).when(distinct, overlap(shapes(a), shapes(b))).otherwise(overlap(wa, wb))


def changes(ingested: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """feed, file_no, change, field_name, new_name: every file of ``ingest_files`` against the one before it in its feed.

    A rescued field that the former schema doesn't know is new, one that it knows with another type ``retyped``; a field
    that doesn't come any more is gone. A field that is gone and one that is new in the same file are one ``renamed``
    field if their types are equal and each is the other's most similar partner, with a likeness of their value
    profiles of at least ``min_similarity``; otherwise they are ``removed`` and ``added``. A file without any entry
    lacks all fields. A feed with one file has no changes.
    """
    # One small row per file and changed field; written once, since every kind of change reads it.
    seen = checkpointed(_evidence(ingested))
    gone = seen.where("side = 'old'").select("feed", (F.col("seq") + 1).alias("seq"), F.col("next_file").alias("file_no"), F.col("field").alias("field_name"), "type", F.col("profile").alias("old_profile"))
    new = seen.where("side = 'new'").select(F.col("feed").alias("_feed"), F.col("seq").alias("_seq"), F.col("file_no").alias("_file"), F.col("field").alias("new_name"), F.col("type").alias("_type"), F.col("profile").alias("new_profile"))
    pairs = _same(gone.where("type is not null"), new, {"feed": "_feed", "seq": "_seq", "type": "_type"}, "inner")
    scored = pairs.withColumn("sim", _similarity(F.col("old_profile"), F.col("new_profile"), F.col("type"))).where(F.col("sim") >= min_similarity)
    by_old = Window.partitionBy("feed", "seq", "field_name").orderBy(F.desc("sim"), "new_name")
    by_new = Window.partitionBy("feed", "seq", "new_name").orderBy(F.desc("sim"), "field_name")
    mutual = scored.withColumn("a", F.row_number().over(by_old)).withColumn("b", F.row_number().over(by_new)).where("a = 1 and b = 1")
    renamed = checkpointed(mutual.select("feed", "seq", "file_no", "field_name", "new_name"))
    taken = renamed.select(F.col("feed").alias("_f"), F.col("seq").alias("_s"), F.col("field_name").alias("_old"), F.col("new_name").alias("_new"))
    removed = _same(gone, taken, {"feed": "_f", "seq": "_s", "field_name": "_old"}, "left_anti")
    added = _same(new, taken, {"_feed": "_f", "_seq": "_s", "new_name": "_new"}, "left_anti").select(F.col("_feed").alias("feed"), F.col("_file").alias("file_no"), "new_name")
    retyped = seen.where("side = 'retyped'").select("feed", "file_no", F.col("field").alias("field_name"))
    row = lambda change, name, other: [F.col("feed"), F.col("file_no"), F.lit(change).alias("change"), F.col(name).alias("field_name"), other.alias("new_name")]
    return (
        renamed.select(*row("renamed", "field_name", F.col("new_name")))
        .unionByName(removed.select(*row("removed", "field_name", F.lit(""))))
        .unionByName(added.select(*row("added", "new_name", F.lit(""))))
        .unionByName(retyped.select(*row("retyped", "field_name", F.lit(""))))
    )


SQL_TYPE = {"integer": "bigint", "decimal": "double", "text": "string", "boolean": "boolean", "list": "string", "object": "string"}


def typed_value(value: Column, kind: str) -> Column:
    """A value that fits ``kind`` as a column of that type; lists and objects as JSON."""
    return F.to_json(value) if kind in ("list", "object") else F.try_variant_get(value, "$", SQL_TYPE[kind])


def _fits(value: Column, found: Column, kind: Column) -> Column:
    """Whether a value of type ``found`` can be a ``kind`` without loss of meaning, as ``typed_value`` has it."""
    text = found == "text"
    return (
        F.when(kind.isin("list", "object", "text"), found == kind)
        .when(kind == "boolean", (found == "boolean") | (text & F.try_variant_get(value, "$", "boolean").isNotNull()))
        .when(kind == "integer", (found.isin("integer", "text")) & F.try_variant_get(value, "$", "bigint").isNotNull())
        .otherwise(found.isin("integer", "decimal", "text") & F.try_variant_get(value, "$", "double").isNotNull())
    )


class RescueIngest:
    """One set of typed fields over drifting files.

    ``target`` maps column names to TYPES; ``aliases`` maps other spellings of a field to its column. A value that is
    unknown or can't be cast stays, as JSON, in the column ``rescued`` (map field -> JSON), so nothing is lost;
    ``replay`` moves rescued values into columns approved later. Null entries give null. A field that comes under two
    names in one row keeps the column's own name, else the first in name order, and rescues the other.
    """

    def __init__(self, target: dict[str, str], aliases: dict[str, str] | None = None) -> None:
        self.target = dict(target)
        self.aliases = {n: n for n in target} | {a: n for a, n in (aliases or {}).items() if n in target}

    def ingest(self, df: DataFrame, keys: list[str], entries: Column) -> DataFrame:
        """keys, one column per target field, rescued."""
        rows = df.select(*keys, F.coalesce(entries, F.create_map().cast("map<string,variant>")).alias("_entries"))
        return self._fill(rows, keys, [])

    def _fill(self, rows: DataFrame, keys: list[str], filled: list[str]) -> DataFrame:
        """One pass over a row's entries says which of them goes to which column; then each column is cast once.
        ``filled``: columns that are there already and take a value only where they have none."""
        e = F.col("_entries")
        if not self.target:
            left = F.map_filter(e, lambda _, v: F.schema_of_variant(v) != "VOID")
            return rows.select(*keys, F.when(F.size(left) > 0, F.transform_values(left, lambda _, v: F.to_json(v))).alias("rescued"))
        literal = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
        column_of, kind_of = literal(self.aliases), literal({a: self.target[n] for a, n in self.aliases.items()})
        held = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in filled])) if filled else F.array().cast("array<string>")
        known = F.transform(F.map_entries(F.map_filter(e, lambda k, _: F.map_contains_key(column_of, k))), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"), value_type(x["value"]).alias("t")))
        fitting = F.filter(known, lambda x: _fits(x["v"], x["t"], kind_of[x["k"]]) & ~F.array_contains(held, column_of[x["k"]]))
        ranked = F.array_sort(F.transform(fitting, lambda x: F.struct(column_of[x["k"]].alias("c"), (column_of[x["k"]] != x["k"]).alias("other"), x["k"].alias("k"))))
        rows = rows.withColumn("_ranked", ranked)
        first = F.filter("_ranked", lambda x, i: (i == 0) | (F.get("_ranked", i - 1)["c"] != x["c"]))
        rows = rows.withColumn("_chosen", F.map_from_entries(F.transform(first, lambda x: F.struct(x["c"], x["k"]))))
        chosen = F.col("_chosen")
        out = []
        for name, kind in self.target.items():
            own = typed_value(F.try_element_at(e, F.try_element_at(chosen, F.lit(name))), kind)
            out.append((F.coalesce(F.col(name), own) if name in filled else own).alias(name))
        used = F.map_values(chosen)
        left = F.map_filter(e, lambda k, v: ~F.array_contains(used, k) & (F.schema_of_variant(v) != "VOID"))
        rescued = F.transform_values(left, lambda _, v: F.to_json(v))
        return rows.select(*[k for k in keys if k not in self.target], *out, F.when(F.size(left) > 0, rescued).alias("rescued"))

    def replay(self, table: DataFrame, promoted: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
        """Promote approved fields and names: their rescued values move into typed columns, new ones and those already
        there, without reading the files again."""
        wanted = aliases or {}
        columns = promoted | {n: self.target[n] for n in wanted.values() if n in self.target}
        wider = RescueIngest(columns, {a: n for a, n in wanted.items() if n in columns})
        kept = [c for c in table.columns if c != "rescued"]
        rows = table.select(*kept, entries_of_fragments(F.coalesce(F.col("rescued"), F.create_map().cast("map<string,string>"))).alias("_entries"))
        self.target |= promoted
        self.aliases |= wider.aliases
        again = wider._fill(rows, kept, [n for n in columns if n in kept])
        return again.select(*kept, *[n for n in promoted if n not in kept], "rescued")


def target_schema(schemas: DataFrame, changed: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Typed fields and aliases from the files' schemas and the reported renames: names linked by renames are one field,
    called by the name most rows hold; its type is the one most rows have. Size: field names, not rows."""
    links = [(r["field_name"], r["new_name"]) for r in changed.where("change = 'renamed'").select("field_name", "new_name").distinct().collect()]
    fields = schemas.select("own", F.inline("fields")).where(F.map_contains_key("own", F.col("field")) & F.col("type").isNotNull())
    held = fields.groupBy("field", "type").agg(F.sum("n_held").alias("n")).collect()
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    names: dict[str, dict[str, int]] = {}
    types: dict[str, dict[str, int]] = {}
    for r in held:
        k = root(r["field"])
        names.setdefault(k, {}).setdefault(r["field"], 0)
        names[k][r["field"]] += r["n"]
        types.setdefault(k, {}).setdefault(r["type"], 0)
        types[k][r["type"]] += r["n"]
    target, aliases, seen = {}, {}, set()
    for k in sorted(names):
        best = max(sorted(names[k]), key=names[k].get)
        column, n = best, 2
        while column.lower() in seen:  # columns differ in more than case
            column, n = f"{best}_{n}", n + 1
        seen.add(column.lower())
        target[column] = max(sorted(types[k]), key=types[k].get)
        aliases |= {a: column for a in names[k]}
    return target, aliases
