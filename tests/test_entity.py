"""Entity resolution: every signal, and blocking against all pairs."""

import random
import re

import pytest

from ledgerlens.operators import entity

DOCS = "doc_id long, file string, head string"
FIRMS = "company_id long, name string, website string"
ALIASES = "company_id long, alias string, alias_type string"


def scores(spark, docs, firms, aliases, **more):
    got = entity.resolve(spark.createDataFrame(docs, DOCS), spark.createDataFrame(firms, FIRMS), spark.createDataFrame(aliases, ALIASES), **more)
    return {(r.doc_id, r.company_id): r.score for r in got.collect()}


@pytest.mark.parametrize(
    ("file", "head", "want"),
    [
        ("x.pdf", "Deck of ARX Holdings today", 0.6),  # alias in the head
        ("arx_holdings.pdf", "nothing", 0.6),  # alias in the file name
        ("x.pdf", "write to arx.example", None),  # a domain alias alone is .3
        ("x.pdf", "Acme Robotics at arx.example", 1.0),  # name, domain alias, fuzzy
        ("acme_robotics.pdf", "nothing", 0.75),  # name and tokens in the file name only
        ("acme_robotics.pdf", "Acme Robotcs", 0.99),  # misspelt in the head
        ("x.pdf", "marx holdings", None),
        (None, "Acme Robotics", 0.75),
        ("acme_robotics.pdf", None, 0.75),
    ],
)
def test_signals(spark, file, head, want):
    firms = [(7, "Acme Robotics Inc", None)]
    aliases = [(7, "ARX Holdings", "legal_name"), (7, "arx.example", "domain"), (7, " ", None), (9, "nothing", "dba")]
    got = scores(spark, [(1, file, head)], firms, aliases).get((1, 7))
    assert got == (want if want is None else pytest.approx(want, abs=1e-4))


def plain(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def brute(docs, firms, aliases, least, stripped, tokens, file_tokens):
    """The reference's sum over all pairs."""
    out = {}
    for d, file, head in docs:
        texts = [f" {' '.join(plain(t))} " for t in (file, head)]
        there = lambda p: bool(plain(p)) and any(f" {' '.join(plain(p))} " in t for t in texts)  # noqa: B023, E731
        for c, name, site in firms:
            mine = [(a.strip().lower(), k) for i, a, k in aliases if i == c]
            raw = 0.6 * any(there(a) for a, k in mine if k != "domain") + 0.5 * there(stripped[c])
            raw += 0.3 * any(f in plain_domains(head) for f in [site, *(a for a, k in mine if k == "domain")] if f)
            nt = tokens[c]
            raw += 0.25 * (sum(t in file_tokens[d] for t in nt) / len(nt)) if nt else 0
            ratio = entity.token_set_ratio(head, stripped[c])
            raw += 0.25 * ratio / 100 if ratio >= 80 else 0
            if raw >= least - 1e-12:
                out[d, c] = round(min(1.0, raw), 4)
    return out


def plain_domains(head):
    return set(re.findall(r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b", (head or "").lower()))


@pytest.mark.parametrize("least", [0.4, 0.55, 0.2])
def test_blocking_loses_nothing(spark, least):
    from pyspark.sql import functions as F

    from ledgerlens.functions import text as X

    rng = random.Random(5)
    words = "red blue north wind x 7 labs sky river stone data of arc moon".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    firms = [(i, some(4) + rng.choice(["", " Inc", " Ltd."]), rng.choice([None, f"f{i}.io"])) for i in range(40)]
    aliases = [(rng.randrange(44), some(2), rng.choice(["dba", None])) for _ in range(15)] + [(i, f"g{i}.com", "domain") for i in range(0, 40, 3)]
    docs = [(i, some(4).replace(" ", "_") + ".pdf", some(5) + rng.choice(["", f" f{rng.randrange(40)}.io", f" g{rng.randrange(40)}.com"])) for i in range(40)]
    made = spark.createDataFrame(firms, FIRMS).select("company_id", X.strip_suffixes(F.col("name")).alias("s"), X.name_tokens(F.col("name")).alias("t")).collect()
    files = {r.doc_id: set(r.t) for r in spark.createDataFrame(docs, DOCS).select("doc_id", X.file_tokens(F.col("file")).alias("t")).collect()}
    want = brute(docs, firms, aliases, least, {r.company_id: r.s for r in made}, {r.company_id: r.t for r in made}, files)
    assert len(want) > 100
    assert scores(spark, docs, firms, aliases, least=least, k=1000) == pytest.approx(want, abs=1.01e-4)


def test_alike_loses_nothing(spark):
    """Every pair of ratio 80 or more is among the candidates, and few others."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwyz") for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 9])))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["a b c d", "ab cd e", "x", "", "Bank", "bank bank"]

    def bent(name):
        t = list(name)
        for _ in range(rng.randint(0, 3)):
            if t:
                k = rng.randrange(len(t))
                t[k] = rng.choice(["", "z", t[k] + "y", " "])
        words = "".join(t).split()
        rng.shuffle(words)
        return " ".join(words + [word() for _ in range(rng.choice([0, 0, 1, 6]))])

    heads = [bent(rng.choice(names)) for _ in range(250)] + ["a b c e", "Bank AG", "", None, "x"]
    docs = spark.createDataFrame(list(enumerate(heads)), "doc_id long, head string")
    firms = spark.createDataFrame(list(enumerate(names)), "company_id long, short string")
    got = {tuple(r) for r in entity.alike(docs, firms).collect()}
    want = {(d, c) for d, h in enumerate(heads) for c, n in enumerate(names) if h and n and entity.token_set_ratio(h, n) >= entity.RATIO}
    assert len(want) > 100 and want <= got
    assert len(got) < len(heads) * len(names) / 3


def test_stored_index(spark, tmp_path):
    """The same pairs from a stored index; blank and orphan aliases aren't in it."""
    firms = spark.createDataFrame([(1, "Acme Bank Inc", "https://www.acme.io/x"), (2, "Blue Bank", None), (3, "Bank", None), (4, None, "")], FIRMS)
    aliases = spark.createDataFrame([(1, "Acme DBA", "dba"), (1, "acme.dev", "domain"), (2, "  ", "dba"), (9, "Ghost", "dba"), (3, None, None)], ALIASES)
    path = str(tmp_path / "index")
    entity.write_index(firms, aliases, path)
    kinds = {(r.kind, r.term, r.company_id) for r in spark.read.parquet(f"{path}/terms").collect() if r.kind != "word"}
    assert kinds == {("domain", "acme.io", 1), ("domain", "acme.dev", 1), ("name", "acme bank", 1), ("name", "blue bank", 2), ("name", "bank", 3), ("alias", "acme dba", 1)}
    keys = {(r.company_id, r.phrase): r.key for r in spark.read.parquet(f"{path}/keys").collect()}
    assert keys == {(1, "acme bank"): "acme", (1, "acme dba"): "acme", (2, "blue bank"): "blue", (3, "bank"): "bank"}
    docs = spark.createDataFrame([(1, "acme_dba.pdf", "nothing"), (2, "x.pdf", "the Blue Bank at acme.dev"), (3, None, None)], DOCS)
    plain = lambda df: sorted(map(tuple, df.collect()))
    for least in (0.4, 0.2):
        assert plain(entity.resolve_stored(docs, path, least=least)) == plain(entity.resolve(docs, firms, aliases, least=least)) != []


def test_least_above_nothing(spark):
    with pytest.raises(ValueError):
        scores(spark, [(1, "a", "b")], [(1, "a", None)], [], least=0)
