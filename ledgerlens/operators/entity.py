"""Entity resolution: stacked signals of documents against companies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from .state import broadcast_if_small, top_k

# Signal weights, thresholds.
ALIAS, NAME, DOMAIN, FILE, FUZZY = 0.60, 0.50, 0.30, 0.25, 0.25
LEAST, BEST, ACCEPT, RATIO = 0.4, 5, 0.85, 80


def _indel(a: str, b: str) -> float:
    """Similarity in percent by longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best similarity of common tokens, common + own of a, common + own of b."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max(_indel(one, two), _indel(common, one) if common else 0.0, _indel(common, two) if common else 0.0)


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _key(kind: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(kind), w))


#: White space as Python's str.split() has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Company tables (words, keys) up to so many rows are broadcast.
ROWS = 200_000


def profile(companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(company_id, name, short, nt, aliases, domains): what documents are compared
    with. Blank aliases are dropped, and those of companies that aren't there."""
    c = companies.select("company_id", F.trim(F.coalesce("name", F.lit(""))).alias("name"), X.host(F.col("website")).alias("host"))
    c = c.withColumns({"nt": X.name_tokens(F.col("name")), "short": X.strip_suffixes(F.col("name"))})
    none = F.array().cast("array<string>")
    if aliases is None:
        c = c.withColumns({"aliases": none, "named": none})
    else:
        a = aliases.select("company_id", F.lower(F.trim("alias")).alias("alias"), F.col("alias_type").eqNullSafe("domain").alias("is_domain")).where("alias <> ''")
        of = lambda kind: F.array_sort(F.collect_set(F.when(kind, F.col("alias"))))
        c = c.join(a.groupBy("company_id").agg(of(~F.col("is_domain")).alias("aliases"), of(F.col("is_domain")).alias("named")), "company_id", "left")
    return c.select("company_id", "name", "short", "nt", F.coalesce("aliases", none).alias("aliases"), F.array_distinct(F.concat(F.coalesce("named", none), F.array_compact(F.array("host")))).alias("domains"))


def terms(companies: DataFrame) -> DataFrame:
    """(kind, term, company_id) of a profile: domains, names and aliases, and the words
    of the latter two; each once."""
    names = F.filter(F.concat(F.array(F.lower("short")), "aliases"), lambda p: p != "")
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("term")))
    every = F.concat(of("domain", F.col("domains")), of("name", F.filter(F.array(F.lower("short")), lambda v: v != "")), of("alias", F.col("aliases")), of("word", F.flatten(F.transform(names, _words))))
    return companies.select("company_id", F.explode(F.array_distinct(every)).alias("t")).select("t.kind", "t.term", "company_id")


def frequencies(rows: DataFrame) -> DataFrame:
    """(kind, term, companies): how many companies have a term."""
    return rows.groupBy("kind", "term").agg(F.count("*").alias("companies"))


def phrase_keys(companies: DataFrame, counted: DataFrame) -> DataFrame:
    """(company_id, phrase, key): a name or alias is looked for by its rarest word, so
    a word that a third of all companies have is a key only where it stands alone."""
    names = F.array_distinct(F.filter(F.concat(F.array(F.lower("short")), "aliases"), lambda p: p != ""))
    rows = companies.select("company_id", F.explode(names).alias("phrase"))
    rows = rows.select("company_id", "phrase", F.explode(F.array_distinct(_words(F.col("phrase")))).alias("term"))
    counts = broadcast_if_small(counted.where("kind = 'word'").select("term", "companies"), ROWS)
    return rows.join(counts, "term").groupBy("company_id", "phrase").agg(F.min(F.struct("companies", "term")).alias("_r")).select("company_id", "phrase", F.col("_r.term").alias("key"))


def write_index(companies: DataFrame, aliases: DataFrame | None, path: str, folders: int = 64) -> None:
    """Store a company index: `profile` (what pairs are scored with), `terms` by kind,
    and `keys` by folder of the key, so that resolving reads them without a shuffle
    of its own or counting again."""
    p = profile(companies, aliases)
    p.write.parquet(f"{path}/profile")
    p = p.sparkSession.read.parquet(f"{path}/profile")
    terms(p).write.partitionBy("kind").parquet(f"{path}/terms")
    counted = frequencies(p.sparkSession.read.parquet(f"{path}/terms"))
    keys = phrase_keys(p, counted).withColumn("folder", F.pmod(F.xxhash64("key"), F.lit(folders)).cast("int"))
    keys.repartition("folder", F.pmod(F.xxhash64("company_id"), F.lit(8))).write.partitionBy("folder").parquet(f"{path}/keys")


def _set(text: Column) -> Column:
    """Distinct words of a text as the token set ratio has them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""))


def _longest_first(words: Column) -> Column:
    return F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a > b, -1).when(a < b, 1).otherwise(0))


def _prefix(words: Column) -> Column:
    """The first words without which less than two thirds of the joined length is left:
    common words of two thirds of it must have one of these."""
    whole = F.length(F.array_join(words, " "))
    return F.filter(words, lambda w, i: F.length(F.array_join(F.slice(words, i + 1, F.size(words)), " ")) * 3 >= whole * 2)


def _pairs(words: Column) -> Column:
    """Every two of the words, each two in one order."""
    w = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat(x, F.lit(" "), y))))


def _grams(words: Column) -> Column:
    """Pairs of letters inside words, numbered where they repeat, in an order by hash."""
    pairs = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda k: F.substr(w, k, F.lit(2)))))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))
    return F.transform(F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), lambda x: x["g"])


def _alike_keys(words: Column, spread: int) -> Column:
    """Keys of what can be 80 % alike letter by letter. With L common letters of S in
    both and t words, at least 3L - S + 1 - 2t pairs of letters inside words are
    common, and L >= .4 S >= 2/3 of the own length: so `least` pairs, and the first
    of all but least - 1 of them in a common order. Texts of many short words have no
    such bound; among themselves they meet by length."""
    length, grams = F.length(F.array_join(words, " ")), _grams(words)
    least = F.ceil(length / 3.0 - 1e-9) + 1 - 2 * F.size(words)
    first = F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.least(F.size(grams), F.size(grams) - F.greatest(least, F.lit(1)) + 1)).cast("int"))
    step = F.floor(F.log(F.greatest(length, F.lit(1))) / F.log(F.lit(1.5))).cast("int")
    by_length = F.when(least < 1, F.transform(F.sequence(step - spread, step + spread), lambda s: F.concat(F.lit("l"), s.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(_key("g", first), by_length)


def alike(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """Pairs (doc_id, company_id) that hold every pair whose token set ratio of head
    and short name is RATIO or more, and few others. docs: (doc_id, head).

    The ratio is the best of three. Common words against the name's, or the head's:
    they are two thirds of it, so one of the prefix is common (the name's rarest words
    first, the head's longest). Both whole: pairs of letters are common (_alike_keys).
    The last two need a head of 1.5 times the name's length at most.
    """
    c = companies.select("company_id", _set(F.col("short")).alias("w")).where(F.size("w") > 0)
    longest = c.agg(F.max(F.length(F.array_join("w", " ")))).first()[0] or 0
    own = c.select("company_id", F.explode("w").alias("word"))
    counts = broadcast_if_small(own.groupBy("word").agg(F.count("*").alias("n")), ROWS)
    rare = own.join(counts, "word").groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("w"))
    ck = rare.select("company_id", F.explode(F.concat(_key("n", _prefix(F.col("w"))), _key("h", F.col("w")), _alike_keys(F.col("w"), 2))).alias("key"))
    d = docs.select("doc_id", _set(F.col("head")).alias("w")).where(F.size("w") > 0)
    size = F.length(F.array_join("w", " "))
    short = F.concat(_key("h", _prefix(_longest_first(F.col("w")))), _alike_keys(F.col("w"), 0))
    dk = d.select("doc_id", F.explode(F.concat(_key("n", F.col("w")), F.when(size <= 1.5 * longest, short).otherwise(F.array().cast("array<string>")))).alias("key"))
    return dk.join(ck, "key").select("doc_id", "company_id").distinct()


def resolve(docs: DataFrame, companies: DataFrame, aliases: DataFrame | None = None, least: float = LEAST, k: int = BEST, fuzzy: bool = True) -> DataFrame:
    """Candidates (doc_id, company_id, score) from docs (doc_id, file, head),
    companies (company_id, name, website) and aliases (company_id, alias,
    alias_type; those of type `domain` are domains, all others names).

    An alias or the name without suffixes counts as a whole word of the file name
    or the head, a domain in the head; fuzzy: the token set ratio of head and name.
    Blocking loses nothing: a pair with an alias, name or domain shares its key; one
    without can reach `least`, above what fuzzy alone gives, only by enough of the
    name's tokens in the file name, so it shares one of the first few, or two of them; below that a
    similarity join (`alike`) finds what fuzzy alone can bring there. least is above 0.
    """
    p = profile(companies, aliases)
    return _resolved(docs, p, phrase_keys(p, frequencies(terms(p))), least, k, fuzzy)


def resolve_stored(docs: DataFrame, path: str, least: float = LEAST, k: int = BEST, fuzzy: bool = True) -> DataFrame:
    """resolve() over an index that write_index() stored."""
    spark = docs.sparkSession
    return _resolved(docs, spark.read.parquet(f"{path}/profile"), spark.read.parquet(f"{path}/keys").drop("folder"), least, k, fuzzy)


def candidates(d: DataFrame, c: DataFrame, keyed: DataFrame, least: float, fuzzy: bool) -> DataFrame:
    """Pairs (doc_id, company_id) to score: every one that can reach `least`."""
    none = F.array().cast("array<string>")
    top = FUZZY if fuzzy else 0.0
    # Of n tokens so many must be in the file name where no other exact signal is; then one of the first
    # n - hits + 1 is. Where it takes two and no token repeats, two of the first n - hits + 2 are: those
    # are the key, since a word like "supplier" alone may be in every name and file.
    share, n = (least - top if least > top else least) / FILE, F.size("nt")
    hits = F.greatest(F.lit(1), F.ceil(share * n - 1e-9)).cast("int")
    two = (hits >= 2) & (F.size(F.array_distinct("nt")) == n)
    front = lambda more: F.slice(_longest_first(F.col("nt")), F.lit(1), F.greatest(n - hits + more, F.lit(1)))
    reached = (n > 0) & (hits <= n)
    first = F.when(reached & ~two, _key("f", front(1))).when(reached, _key("p", _pairs(front(2)))).otherwise(none)
    dk = d.select("doc_id", F.explode(F.array_distinct(F.concat(_key("f", F.col("ft")), _key("p", _pairs(F.col("ft"))), _key("w", F.concat(_words(F.col("file")), _words(F.col("head")))), _key("d", F.col("dom"))))).alias("key"))
    ck = c.select("company_id", F.explode(F.concat(first, _key("d", F.col("domains")))).alias("key")).unionByName(keyed.select("company_id", F.concat(F.lit("w"), "key").alias("key"))).distinct()
    pairs = dk.join(broadcast_if_small(ck, ROWS), "key").select("doc_id", "company_id")
    if fuzzy and least <= top:
        pairs = pairs.unionByName(alike(d, c))
    return pairs.distinct()


def _resolved(docs: DataFrame, c: DataFrame, keyed: DataFrame, least: float, k: int, fuzzy: bool) -> DataFrame:
    if least <= 0:
        raise ValueError("least must be above 0, or every pair would count")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = docs.select("doc_id", text("file").alias("file"), text("head").alias("head"))
    d = d.withColumns({"ft": X.file_tokens(F.col("file")), "dom": X.domains(F.col("head"))})
    top = FUZZY if fuzzy else 0.0
    j = candidates(d, c, keyed, least, fuzzy).join(d, "doc_id").join(c, "company_id")
    said = lambda x: X.whole_word(x, F.col("file")) | X.whole_word(x, F.col("head"))
    alias = F.when(F.exists("aliases", said), ALIAS).otherwise(0.0)
    name = F.when(said(F.col("short")), NAME).otherwise(0.0)
    domain = F.when(F.arrays_overlap("dom", "domains"), DOMAIN).otherwise(0.0)
    file = FILE * X.token_overlap(F.col("nt"), F.col("ft"))
    scored = j.select("doc_id", "company_id", "head", "short", (alias + name + domain + file).alias("raw")).where(F.col("raw") + top >= least)
    if fuzzy:
        ratio = token_set_ratio_udf(F.col("head"), F.col("short"))
        scored = scored.withColumn("ratio", ratio).withColumn("raw", F.col("raw") + F.when(F.col("ratio") >= RATIO, FUZZY * (F.col("ratio") / 100.0)).otherwise(0.0)).where(F.col("raw") >= least)
    best = scored.select("doc_id", "company_id", F.round(F.least(F.lit(1.0), "raw"), 4).alias("score"))
    return top_k(best, ["doc_id"], [F.desc("score"), F.asc("company_id")], k)
