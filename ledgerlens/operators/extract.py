"""Text to observations. One pass over the chunks for all rules."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions import temporal as M
from ..functions import text as X
from ..sources.rules import Rule, factors
from .state import broadcast_if_small, first_by, top_k

_OUT = ["value", "evidence", "period_label", "scenario", "as_of_date"]


def _candidate(rule: Rule, pattern: str) -> Column:
    """The first match of a pattern; null for none. Where the text, in small letters
    as `_low`, lacks what every match holds, it never runs, as is so of most patterns."""
    text, needed = F.col("text"), sorted(factors(pattern))
    unit = F.regexp_extract(text, pattern, 2) if rule.kind == "money" else F.lit("")
    amount = F.rtrim(F.regexp_extract(text, pattern, 1), F.lit(".,"))
    bound = lambda x: F.lit(x).cast("double")
    fields = {"code": F.lit(rule.code), "method": F.lit("regex"), "confidence": F.lit(rule.confidence), "granularity": F.lit(rule.granularity), "currency": F.lit(rule.currency).cast("string"), "low": bound(rule.low), "high": bound(rule.high), "dated": F.lit("as_of_date" in rule.requires or "scenario" in rule.requires)}
    x = M.once(amount, lambda a: M.once(unit, lambda u: N.money(a, u)))
    row = lambda m: F.struct(*[v.alias(k) for k, v in (fields | {"at": F.regexp_instr(text, F.lit(pattern)), "m": m, "x": x}).items()])
    made = M.once(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", row(m)))
    return F.when(reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(f)) for f in needed]), made) if needed else made


def _row(head: dict[str, Column], value: Column, evidence: Column, label: Column, scenario: Column, date: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in head.items()], value.alias("value"), evidence.alias("evidence"), label.alias("period_label"), scenario.alias("scenario"), date.alias("as_of_date"))


def _enum(rule: Rule) -> Column:
    """Earliest keyword wins, ties by the rule's order; null if there is none."""
    low = F.col("_low")
    hits = F.filter(F.array(*[F.struct(F.position(F.lit(w), low).alias("at"), F.lit(i).alias("i"), F.lit(v).alias("v"), F.lit(len(w)).alias("n")) for i, (w, v) in enumerate(rule.choices)]), lambda h: h["at"] > 0)
    head = {"code": F.lit(rule.code), "method": F.lit("enum_map"), "confidence": F.lit(rule.confidence), "granularity": F.lit(rule.granularity), "currency": F.lit(None).cast("string")}
    none = F.lit(None)
    row = lambda first: _row(head, first["v"], X.context(F.col("text"), first["at"], first["n"]), none.cast("string"), none.cast("string"), none.cast("date"))
    gate = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in rule.gate]) if rule.gate else F.lit(True)
    return F.when(gate, M.once(F.array_min(hits), lambda first: F.when(first.isNotNull(), row(first))))


def extract(chunks: DataFrame, rules: list[Rule], as_of: Column, keys: list[str], codes: list[str] | None = None) -> DataFrame:
    """(keys, metric_code, value, evidence, period_label, scenario, as_of_date,
    method, confidence, ...): at most one observation a chunk and metric. A
    pattern's first match counts; if it breaks range or contract, the next
    pattern is tried. No shuffle: candidates stay in an array on the chunk's row."""
    rules = [r for r in rules if codes is None or r.code in codes]
    text, kept = F.col("text"), ["code", "method", "confidence", "granularity", "currency"]
    df = chunks.select(*keys, "text", F.lower("text").alias("_low"))
    slots = [F.array_compact(F.array(*[_enum(r) for r in rules if r.kind == "enum"]))] if any(r.kind == "enum" for r in rules) else []
    tries = [_candidate(r, p) for r in rules if r.kind != "enum" for p in r.patterns]
    if tries:
        # Each step is a column of its own, so that labels are looked for and read once.
        df = df.withColumn("_c", F.filter(F.array_compact(F.array(*tries)), lambda c: N.within(c["x"], c["low"], c["high"])))
        df = df.withColumn("_l", F.transform("_c", lambda c: M.nearby_label(text, c["at"], F.length(c["m"]))))
        df = df.withColumn("_p", F.transform("_l", lambda label: M.parse_label(label, as_of)))
        dated = lambda i: F.get("_p", i)["as_of_date"].isNotNull()
        made = F.transform("_c", lambda c, i: F.when(~c["dated"] | dated(i), _row({k: c[k] for k in kept}, N.value_text(c["x"]), X.context(text, c["at"], F.length(c["m"])), F.when(dated(i), F.get("_l", i)), F.get("_p", i)["scenario"], F.get("_p", i)["as_of_date"])))
        df = df.withColumn("_o", F.array_compact(made))
        slots.append(F.filter("_o", lambda o, i: ~F.exists(F.slice("_o", F.lit(1), i), lambda d: d["code"] == o["code"])))
    # Outer, since the filter inferred from an inner one would do all of the above twice.
    found = df.select(*keys, F.explode_outer(F.concat(*slots)).alias("o")).where("o is not null")
    return found.select(*keys, F.col("o.code").alias("metric_code"), *[F.col(f"o.{c}").alias(c) for c in _OUT], "o.method", "o.confidence", F.col("o.granularity").alias("period_granularity"), "o.currency")


def dedupe(observations: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(observations, keys, order)


# Row labels by metric, first group wins.
ROW_LABELS = {"arr": ["arr", "annual recurring revenue"], "revenue": ["revenue", "sales"], "gross_margin": ["gross margin", "gm"], "burn_rate": ["burn"], "customer_count": ["customers", "customer count"], "employee_count": ["headcount", "employees", "fte", "team"]}
PERIOD = r"^(?:FY)?\s?(?:19|20)[0-9]{2}[EPF]?\z|^[Qq][1-4]['\s]*(?:19|20)?[0-9]{2}[EPF]?\z"


def row_metric(label: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9%]+", " "))
    out = F.lit(None).cast("string")
    for code, names in reversed(ROW_LABELS.items()):
        out = F.when(X.any_of(plain, names), F.lit(code)).otherwise(out)
    return out


def table_header(grid: Column) -> Column:
    """0-based index of the first of five rows with two period cells at least; null if none."""
    head = F.transform(F.slice(grid, 1, 5), lambda row, i: F.when(F.size(F.filter(row, lambda c: c.rlike(PERIOD))) >= 2, i))
    return F.array_min(F.filter(head, lambda i: i.isNotNull()))


def table_observations(tables: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Unpivot: tables (keys, grid: array<array<string>>) to a row a metric cell."""
    # Outer explodes stand before the filters: below them a filter would clean grids and read
    # rows and cells once more for each of its uses. Tables without a header end at the first.
    grid = F.filter(F.array(F.struct(F.transform("grid", X.clean_row).alias("grid"))), lambda g: g["grid"].isNotNull())
    headed = F.filter(F.transform(grid, lambda g: F.struct(table_header(g["grid"]).alias("h"), g["grid"].alias("grid"))), lambda g: g["h"].isNotNull())
    t = tables.select(*keys, F.explode_outer(headed).alias("_t")).where("_t is not null").select(*keys, F.col("_t.h").alias("_h"), "_t.grid")
    units = M.once(F.array_join(F.flatten(F.slice("grid", 1, 3)), " "), N.table_units)
    # The header's periods are read once a table; rows then look only at their columns.
    head = F.transform(F.element_at("grid", F.col("_h") + 1), lambda c, i: F.struct(i.alias("col"), c.alias("label")))
    t = t.select(*keys, "_h", units.alias("_u"), F.filter(head, lambda x: x["label"].rlike(PERIOD)).alias("_cols"), "grid")
    t = t.withColumn("_p", F.transform("_cols", lambda x: M.parse_label(x["label"], as_of)))
    rows = t.select(*keys, "_u", "_cols", "_p", F.posexplode_outer("grid").alias("_r", "row"), "_h").where("_r > _h")
    label = F.try_element_at(F.filter("row", lambda c: c != ""), F.lit(1))
    rows = rows.select(*keys, "_u", "_cols", "_p", "_r", "row", M.once(label, row_metric).alias("metric_code"))
    cell = lambda x, p: F.struct(x["col"].alias("col"), x["label"].alias("label"), F.get("row", x["col"]).alias("cell"), p.alias("p"))
    valued = F.transform(F.zip_with("_cols", "_p", cell), lambda c: F.struct(c.alias("c"), M.once(c["cell"], lambda s: N.table_cell(s, F.col("metric_code"), F.col("_u"))).alias("value")))
    cells = rows.select(*keys, "metric_code", "_r", F.explode_outer(F.when(F.col("metric_code").isNotNull(), F.filter(valued, lambda c: c["value"].isNotNull()))).alias("_c")).where("_c is not null")
    return cells.select(*keys, "metric_code", F.col("_r").alias("row"), "_c.c.col", F.col("_c.c.label").alias("period_label"), "_c.value", "_c.c.cell", F.col("_c.c.p.scenario").alias("scenario"), F.col("_c.c.p.as_of_date").alias("as_of_date"))


def matrix_observations(chunks: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Flattened matrix: period labels zipped with each metric's values (shorter list rules)."""
    periods = F.regexp_extract_all("text", F.lit(r"\b(20[0-9]{2}[EPF]?)\b"), F.lit(1))
    df = chunks.select(*keys, "text", M.once(periods, lambda p: F.slice(p, F.greatest(F.size(p) - 4, F.lit(1)), F.lit(5))).alias("_p"))
    specs = {"arr": r"ARR \(\$M\)\s+((?:[0-9.]+\s*)+)", "gross_margin": r"Gross margin\s+((?:-?[0-9]{1,3}%\s*)+)", "customer_count": r"Customers\s+((?:[0-9]+\s*)+)"}
    lists = [F.struct(F.lit(code).alias("metric_code"), F.filter(F.split(F.trim(F.regexp_extract("text", p, 1)), r"\s+"), lambda v: v != "").alias("v")) for code, p in specs.items()]
    # Outer, and the filter after it, or periods and lists would be read twice.
    rows = df.select(*keys, "_p", F.explode_outer(F.when(F.size("_p") >= 3, F.array(*lists))).alias("m")).where("m is not null")
    n = F.least(F.size("_p"), F.size("m.v"))
    pairs = rows.where(n > 0).select(*keys, "m.metric_code", F.explode(F.arrays_zip(F.slice("_p", F.lit(1), n).alias("label"), F.slice("m.v", F.lit(1), n).alias("cell"))).alias("z"))
    out = pairs.select(*keys, "metric_code", F.col("z.label").alias("period_label"), F.col("z.cell").alias("cell")).withColumn("_d", M.parse_label(F.col("period_label"), as_of))
    return out.select(*keys, "metric_code", "period_label", N.matrix_value(F.col("metric_code"), F.col("cell")).alias("value"), F.col("_d.scenario").alias("scenario"), F.col("_d.as_of_date").alias("as_of_date"))


def retrieve(chunks: DataFrame, query: list[str], group: list[str], order: str, k: int) -> DataFrame:
    """Top k chunks of a group by how many query words they have; ties by order."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))
    score = F.size(F.array_intersect(words, F.array(*[F.lit(q) for q in query])))
    return top_k(chunks.withColumn("score", score).where("score > 0"), group, [F.desc("score"), F.asc(order)], k)


#: Quotes, and characters of quotes, looked for in one pass over the texts (a bound on memory only).
QUOTES, QUOTE_CHARS = 20_000, 4_000_000


def contains_join(texts: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Pairs where the quote is in the text, of any length, wherever words begin.
    An empty quote is in every text, a null one or a null text in no pair.

    The quotes, a stated query set, are taken in blocks; an automaton of a block's
    (Aho and Corasick) finds all of them in one pass over the texts, without keys,
    shuffles or copies of texts without a match.
    """
    spark = texts.sparkSession
    at, schema = texts.columns.index(text), T.StructType([*texts.schema.fields, T.StructField("_quote", T.StringType())])
    wanted = quotes.select(F.col(quote).alias("q")).where("q is not null").distinct()

    def one_pass(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most QUOTES

        def find(batches):
            find_all = _automaton(shared.value)
            for b in batches:
                rows, found = [], []
                for k, t in enumerate(b.column(at).to_pylist()):
                    if t is not None:
                        hits = find_all(t)
                        rows += [k] * len(hits)
                        found += hits
                if rows:
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, pa.array(found, pa.string())], names=[*b.schema.names, "_quote"])

        return texts.mapInArrow(find, schema)

    out, block, size = None, [], 0
    for r in wanted.toLocalIterator():
        block.append(r["q"])
        size += len(r["q"])
        if len(block) == QUOTES or size >= QUOTE_CHARS:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block, size = [], 0
    if block or out is None:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out.join(broadcast_if_small(quotes), F.col("_quote") == F.col(quote)).drop("_quote")


def _automaton(quotes: list[str]):
    """A function that gives the distinct quotes in a text."""
    import ahocorasick

    empty = [q for q in quotes if not q]
    machine = ahocorasick.Automaton()
    for q in quotes:
        if q:
            machine.add_word(q, q)
    if not len(machine):
        return lambda text: empty
    machine.make_automaton()
    return lambda text: [*empty, *dict.fromkeys(q for _, q in machine.iter(text))]
