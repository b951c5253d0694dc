"""Mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source. A domain is a set of sources (DOMAINS; others are in "other"); every level has whole
numbers as weights (1 where none is given). A document's tokens are its longest runs without blank, tab, CR or LF.

Budgets (``budgets``). A node's capacity is what its leaves hold times MAX_EPOCHS. Each node's budget goes to its children
by weight; a child whose capacity is less gets its capacity, and what it leaves goes to its siblings, again by weight. Only
what all siblings together can't take is left to their parent's siblings. Shares are rounded down to whole tokens, so that at
most one token a child and round is lost.

Selection (``mix``). A leaf's documents are in the order of md5(seed:epoch:doc_id), another one each epoch. Whole epochs are
taken while the budget holds, of the last one the longest prefix whose tokens don't exceed it. The prefix is found without
sorting a leaf: sums of 4,096 hash ranges give the range where the budget ends, and only this range's ids are
summed row by row. What comes out is a cut point for each leaf, so texts are filtered where they are read and never shuffled.

Result of ``mix``: the rows taken, with their columns, and ``epoch`` from 0. Repeated rows of one id have one place in
the order and are in or out together. A null id, language or source counts as the empty string; null and empty texts have no tokens and
are in as soon as the prefix reaches them. An empty table gives an empty result. A column named ``epoch`` is replaced (with ``number_epochs`` False nothing is added or
replaced, and a row taken n times comes n times); columns of other names stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkwright.llm import common as C

DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4"], "books": ["src5", "src6", "src7", "src8", "src9"], "code": ["src10", "src11", "src12", "src13", "src14"]}
DOMAIN_WEIGHTS = {"web": 4, "books": 2, "code": 2, "other": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: The budget as a share of all tokens, and how often a document may be taken.
TOTAL, MAX_EPOCHS, SEED = (9, 10), 2, "mix-1"
RANGES = 4096
LEAF = ["domain", "lang_key", "source_key"]


def tokens() -> Column:
    return F.coalesce(F.size(F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda x: x != "")).cast("bigint"), F.lit(0).cast("bigint"))


def token_count() -> Column:
    return F.when(F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(tokens())


def domain_of(domains: dict[str, list[str]]) -> Column:
    c = F.lit("other")
    for name in sorted(domains, reverse=True):
        c = F.when(F.col("source").isin(domains[name]), F.lit(name)).otherwise(c)
    return c


def leaves(docs: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    return docs.select("doc_id", "text", domain_of(domains).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang_key"), F.coalesce("source", F.lit("")).alias("source_key"))


def fill(amount: int, children: dict, weight, capacity: dict) -> dict:
    """amount to the children by weight, none above its capacity; what one leaves goes to the others."""
    order = sorted(children)
    total = sum(weight(c) for c in order)
    if total == 0:
        got = {}
        for c in order:
            got[c] = min(capacity[c], amount)
            amount -= got[c]
        return got
    weigh = {c: weight(c) for c in order}
    # Who fills at the lowest level comes first; the first that doesn't fill sets the level for itself and all after it.
    by_level = sorted((c for c in order if weigh[c]), key=lambda c: Fraction(capacity[c], weigh[c]))
    got = {c: 0 for c in order}
    for k, c in enumerate(by_level):
        if capacity[c] * total > amount * weigh[c]:
            return got | {d: amount * weigh[d] // total for d in by_level[k:]}
        got[c] = capacity[c]
        amount, total = amount - got[c], total - weigh[c]
    if amount > 0:  # only those without a weight are left
        return got | fill(amount, [c for c in order if not weigh[c]], lambda c: 0, capacity)
    return got


def budgets(supply: dict[tuple[str, str, str], int], total: int, weights: tuple[dict, dict, dict], max_epochs: int) -> dict[tuple[str, str, str], int]:
    """The budget of each leaf; supply is the tokens of each leaf."""

    def share(amount: int, level: int, mine: dict) -> dict:
        groups = defaultdict(dict)
        for leaf, n in mine.items():
            groups[leaf[level]][leaf] = n
        capacity = {g: sum(x.values()) * max_epochs for g, x in groups.items()}
        got = fill(min(amount, sum(capacity.values())), groups, lambda g: weights[level].get(g, 1), capacity)
        if level == 2:
            return {leaf: got[leaf[2]] for leaf in mine}
        return {leaf: b for g, x in groups.items() for leaf, b in share(got[g], level + 1, x).items()}

    return share(total, 0, supply) if supply else {}


def place(seed: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(docs: DataFrame, total: int | None, weights: tuple[dict, dict, dict], domains: dict, max_epochs: int, seed: str, share: tuple[int, int] = TOTAL) -> DataFrame:
    """One row a leaf: budget, whole epochs, and the last place (md5) taken of the epoch after them (empty: none). The rows are as many as the leaves, not as the documents."""
    spark = docs.sparkSession
    sizes = C.cut(leaves(docs, domains).select(*LEAF, "doc_id", token_count().alias("n")))
    supply = {(r[0], r[1], r[2]): r["n"] for r in sizes.groupBy(*LEAF).agg(F.sum("n").alias("n")).toLocalIterator()}
    if total is None:
        total = sum(supply.values()) * share[0] // share[1]
    got = budgets(supply, total, weights, max_epochs)
    rows = [(*leaf, n, got[leaf], got[leaf] // n if n else 0, got[leaf] % n if n else 0) for leaf, n in sorted(supply.items())]
    given = spark.createDataFrame(rows, "domain string, lang_key string, source_key string, supply bigint, budget bigint, epochs bigint, rest bigint")
    keyed = sizes.join(F.broadcast(given) if len(rows) <= 100_000 else given, LEAF).where("rest > 0 or supply = 0").withColumn("place", place(seed, F.col("epochs"))).withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    sums = keyed.groupBy(*LEAF, "range", "rest").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Of each leaf the last range that begins within the budget.
    edge = sums.withColumn("before", before).where(F.col("before") <= F.col("rest")).groupBy(*LEAF).agg(F.max_by("range", "range").alias("range"), F.max_by("before", "range").alias("before"))
    inside = keyed.join(edge, [*LEAF, "range"]).groupBy(*LEAF, "place", "before", "rest").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*LEAF).orderBy("place"))
    last = inside.withColumn("upto", upto).where("upto <= rest").groupBy(*LEAF).agg(F.max("place").alias("within"))
    # Where no place of that range fits, the cut is just before it.
    cut = edge.join(last, LEAF, "left").select(*LEAF, F.coalesce("within", F.lpad(F.conv(F.col("range").cast("string"), 10, 16), 3, "0")).alias("cut"))
    return given.join(cut, LEAF, "left").select(*LEAF, "supply", "budget", "epochs", F.lower(F.coalesce("cut", F.lit(""))).alias("cut"))


def mix(docs: DataFrame, total: int | None = None, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS), domains: dict = DOMAINS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, share: tuple[int, int] = TOTAL, number_epochs: bool = True) -> DataFrame:
    """The rows taken, with ``epoch``."""
    cuts = C.cut(plan(docs, total, weights, domains, max_epochs, seed, share)).select(*LEAF, "epochs", "cut")
    small = cuts.count() <= 100_000  # a row has about 100 bytes
    columns = [c for c in docs.columns if c != "epoch"] if number_epochs else docs.columns
    # The caller's columns travel in one, so that no name can clash.
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), domain_of(domains).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang_key"), F.coalesce("source", F.lit("")).alias("source_key"), "doc_id")
    times = F.col("epochs") + (place(seed, F.col("epochs")) <= F.col("cut")).cast("bigint")
    taken = mine.join(F.broadcast(cuts) if small else cuts, LEAF, "left").select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("number"))
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), *([F.col("number").alias("epoch")] if number_epochs else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(weights: dict[str, int], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in sorted(weights.items())) + " else 1 end" if weights else "1"


def _fill_sql(name: str, source: str, parent: list[str], child: str, weight: str, amount: str) -> str:
    """Water-filling in closed form: children by capacity / weight; the first that doesn't fill sets the level for it and all after it."""
    by = f"partition by {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, child])
    order = "order by cap::hugeint * 1000000000000 // w, " + child
    return f"""{name}_c as (select {keys}, sum(cap)::hugeint as cap, any_value({weight})::hugeint as w from {source} group by {keys}),
{name}_o as (select c.*, {amount} as amount, coalesce(sum(cap) over ({by} {order} rows between unbounded preceding and 1 preceding), 0)::hugeint as used, sum(w) over ({by} {order} rows between current row and unbounded following)::hugeint as left_w from {name}_c c {{join}}),
{name}_f as (select *, cap * left_w <= (amount - used) * w as fills from {name}_o),
{name}_l as (select *, min(case when not fills then used end) over ({by}) as at_used, max(case when not fills then left_w end) over ({by}) as at_w from {name}_f),
{name} as (select {keys}, case when fills then cap else (amount - at_used) * w // at_w end as budget from {name}_l)"""


def _sql() -> str:
    domain = "case " + " ".join(f"when source in ({', '.join(repr(s) for s in v)}) then '{k}'" for k, v in DOMAINS.items()) + " else 'other' end"
    first = _fill_sql("b1", "leaf", [], "domain", _case(DOMAIN_WEIGHTS, "domain"), f"(select least(sum(n) * {TOTAL[0]} // {TOTAL[1]}, sum(cap)) from leaf)").format(join="")
    second = _fill_sql("b2", "leaf", ["domain"], "lang_key", _case(LANGUAGE_WEIGHTS, "lang_key"), "b.budget").format(join="join b1 b using (domain)")
    third = _fill_sql("b3", "leaf", ["domain", "lang_key"], "source_key", _case(SOURCE_WEIGHTS, "source_key"), "b.budget").format(join="join b2 b using (domain, lang_key)")
    return f"""
with d as (select *, {domain} as domain, coalesce(lang, '') as lang_key, coalesce(source, '') as source_key, coalesce(len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')), 0)::bigint as n from documents),
leaf as (select domain, lang_key, source_key, sum(n)::hugeint as n, (sum(n) * {MAX_EPOCHS})::hugeint as cap from d group by all),
{first},
{second},
{third},
p as (select l.*, b3.budget // greatest(l.n, 1) as epochs, b3.budget % greatest(l.n, 1) as rest from leaf l join b3 using (domain, lang_key, source_key)),
k as (select d.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs::varchar || ':' || coalesce(d.doc_id::varchar, '')) as place from d join p using (domain, lang_key, source_key)),
s as (select *, sum(n) over (partition by domain, lang_key, source_key order by place range between unbounded preceding and current row) as upto from k),
t as (select *, epochs + (upto <= rest)::int as times from s)
select doc_id, text, lang, source, n_chars, unnest(range(times::bigint)) as epoch from t where times > 0
"""


SQL = _sql()
