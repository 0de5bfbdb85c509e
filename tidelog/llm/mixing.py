"""Mixing sources to target weights: hierarchical budgeting.

A budget of tokens flows down a tree of domains, languages and sources, in proportion to weights. A child that can't
take its share (its tokens, times the most epochs allowed) is filled, and what it leaves goes to its siblings by
their weights; only what a whole family can't take goes to its parent's siblings. Each leaf then reads seeded epochs:
whole ones first, then of the next epoch's order the longest prefix that fits.

Only DataFrame functions run here, on integers, so results don't depend on the order of rows. The prefix of a leaf
with a third of all rows is found through sums of hash buckets; rows are put in order in the one bucket where the
quota ends.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm._common import Scratch, lookup_join

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf for each hash bucket, and the most buckets of a leaf.
BUCKET_ROWS, BUCKETS = 1000, 65536


@dataclass(frozen=True)
class Mix:
    """Weights are positive integers; a name without one has ``other``. ``share`` of all tokens is the budget, in
    thousandths; a document is read in ``epochs`` epochs at most."""

    domain_of: Mapping[str, str] = field(default_factory=dict)
    other_domain: str = "other"
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 1
    share: int = 1000
    epochs: int = 2
    seed: str = "mix"

    def __post_init__(self):
        if self.epochs < 1 or self.share < 0 or min([self.other, *(w for x in self.weights.values() for w in x.values())]) < 1:
            raise ValueError("weights and epochs must be 1 or more, the share 0 or more")

    def domain(self, source: Column) -> Column:
        out = F.lit(self.other_domain)
        by: dict[str, list[str]] = {}
        for name, to in self.domain_of.items():
            by.setdefault(to, []).append(name)
        for to, names in by.items():
            out = F.when(source.isin(names), F.lit(to)).otherwise(out)
        return out

    def weight(self, level: str, name: Column) -> Column:
        out = F.lit(self.other)
        for k, w in self.weights.get(level, {}).items():
            out = F.when(name == k, F.lit(w)).otherwise(out)
        return out.cast("long")


#: The query's and the pipeline's mix of the 20 sources.
PRODUCTION = Mix(
    domain_of={f"src{i}": "web" if i < 10 else "books" if i < 15 else "forums" for i in range(20)},
    weights={"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}},
    seed="mix-1",
)


def tokens_of(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its UTF-8 bytes, rounded up; null has none."""
    return F.coalesce((F.octet_length(text) + 3).cast("long") / 4, F.lit(0)).cast("long")


def _order(mix: Mix, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def _fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``quota`` for each child from its parents' ``given``, by ``weight`` and within ``room``: water filling."""
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), name)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    out = children.withColumns({"__room": F.sum("room").over(upto), "__after": F.sum("weight").over(by) - F.sum("weight").over(upto)})
    # a child is full if the level that fills it needs no more than is given
    out = out.withColumn("__full", F.col("__room") * F.col("weight") + F.col("room") * F.col("__after") <= F.col("given") * F.col("weight"))
    out = out.withColumns({"__taken": F.sum(F.when(F.col("__full"), F.col("room")).otherwise(0)).over(by), "__open": F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(by)})
    out = out.withColumn("__share", F.when(F.col("__full"), F.col("room")).otherwise(F.expr("(given - __taken) * weight div greatest(__open, 1)")))
    # what rounding down leaves: a token each for the first open children
    out = out.withColumns({"__left": F.col("given") - F.sum("__share").over(by), "__nth": F.sum(F.when(F.col("__full"), 0).otherwise(1)).over(by.orderBy(name).rowsBetween(W.unboundedPreceding, 0))})
    out = out.withColumn("quota", (F.col("__share") + F.when(~F.col("__full") & (F.col("__nth") <= F.col("__left")), 1).otherwise(0)).cast("long"))
    return out.drop("__room", "__after", "__full", "__taken", "__open", "__share", "__left", "__nth")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    renamed = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    return a.join(renamed, [a[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]).drop(*[f"__{k}" for k in keys])


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, docs, supply) with weight, room and quota, by the rule above."""
    room = leaves.withColumn("room", F.col("supply") * mix.epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = room.groupBy(*keys).agg(F.sum("room").alias("room")).withColumn("weight", mix.weight(level, F.col(level)))
        if given is None:
            total = leaves.agg((F.sum("supply") * mix.share / 1000).cast("long").alias("given"))
            children = children.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one").drop("__one")
        else:
            children = _same(children, given, keys[:-1])
        filled = _fill(children, keys[:-1], level)
        given = filled.select(*keys, F.col("quota").alias("given"))
    return _same(leaves, filled.select(*LEVELS, "weight", "room", "quota"), list(LEVELS))


def plan(docs: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """One row per leaf: its quota, ``whole`` epochs, and where the prefix of the next epoch ends.

    ``docs`` has doc_id, domain, lang, source, tokens. The prefix holds the hash buckets below ``cut_bucket`` and,
    in it, the rows up to (``cut_hash``, ``cut_doc``).
    """
    leaves = scratch.table(docs.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("supply")), "leaves")
    quotas = budgets(leaves, mix).withColumns({"whole": F.expr("if(supply = 0, 0, quota div greatest(supply, 1))"), "rest": F.expr("if(supply = 0, 0, quota % greatest(supply, 1))")})
    quotas = scratch.table(quotas.withColumn("buckets", F.greatest(F.lit(1), F.least(F.expr(f"docs div {BUCKET_ROWS}"), F.lit(BUCKETS))).cast("long")), "quotas")
    hashed = _hashed(lookup_join(docs, quotas.where("rest > 0"), list(LEVELS)), mix)
    sums = hashed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    before = F.sum("held").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("held")
    cross = sums.withColumn("before", before).where("before <= rest and rest < before + held").select(*LEVELS, F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("before")).alias("fits"))
    cross = scratch.table(cross, "cross")
    inside = lookup_join(hashed, cross, list(LEVELS)).where("bucket = cut_bucket")
    reach = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("hash", "doc_id").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = inside.withColumn("reach", reach).where("reach <= fits").groupBy(*LEVELS).agg(F.max(F.struct("hash", "doc_id")).alias("last"))
    ends = _left(cross, last).select(*LEVELS, "cut_bucket", F.col("last.hash").alias("cut_hash"), F.col("last.doc_id").alias("cut_doc"))
    return scratch.table(_left(quotas, ends), "plan")


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    renamed = b.withColumnsRenamed({k: f"__{k}" for k in LEVELS})
    return a.join(renamed, [a[k].eqNullSafe(renamed[f"__{k}"]) for k in LEVELS], "left").drop(*[f"__{k}" for k in LEVELS])


def _hashed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The order of each document in its leaf's partial epoch, and the hash bucket of it."""
    out = docs.withColumn("hash", _order(mix, F.col("whole"), F.col("doc_id")))
    return out.withColumn("bucket", F.expr("shiftright(cast(conv(substr(hash, 1, 8), 16, 10) as long) * buckets, 32)"))


def mixed(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """``docs`` (doc_id, text, lang, source and further columns), a row for each epoch that reads it, with
    ``mix_domain``, ``mix_tokens`` and ``mix_epoch``.

    Null texts have no tokens; a null lang or source is a name of its own with the weight ``other``; a null doc_id
    has a place in the order as well. Rows with the same doc_id in a leaf are tied: they are read together or not at
    all. Documents without tokens are read where their place falls within the prefix. An empty table gives no rows.
    Very long texts count by their bytes like others. A column of ``docs`` that has the name of one of the three added
    ones is replaced by it.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_domain", "mix_tokens", "mix_epoch")
    slim = docs.select(F.col("doc_id"), mix.domain(F.col("source")).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), tokens_of(F.col("text")).alias("tokens"))
    slim = scratch.table(slim, "slim")
    leaf = {"domain": "mix_domain", "lang": "__mix_lang", "source": "__mix_source", "tokens": "mix_tokens"}
    chosen = plan(slim, mix, scratch).withColumnsRenamed({"domain": "__d", "lang": "__l", "source": "__s"}).select("__d", "__l", "__s", *[F.col(c).alias(f"__mix_{c}") for c in ("whole", "rest", "buckets", "cut_bucket", "cut_hash", "cut_doc")])
    rows = docs.withColumns({leaf["domain"]: mix.domain(F.col("source")), leaf["lang"]: F.col("lang").cast("string"), leaf["source"]: F.col("source").cast("string"), leaf["tokens"]: tokens_of(F.col("text"))})
    rows = lookup_join(rows.withColumns({"__d": F.col("mix_domain"), "__l": F.col("__mix_lang"), "__s": F.col("__mix_source")}), chosen, ["__d", "__l", "__s"])
    rows = rows.withColumn("__mix_hash", _order(mix, F.col("__mix_whole"), F.col("doc_id")))
    rows = rows.withColumn("__mix_bucket", F.expr("shiftright(cast(conv(substr(__mix_hash, 1, 8), 16, 10) as long) * __mix_buckets, 32)"))
    # null ids come first among equal hashes, as in the order above
    at, end = F.struct(F.col("__mix_hash"), F.col("doc_id")), F.struct(F.col("__mix_cut_hash"), F.col("__mix_cut_doc"))
    partial = (F.col("__mix_rest") > 0) & ((F.col("__mix_bucket") < F.col("__mix_cut_bucket")) | ((F.col("__mix_bucket") == F.col("__mix_cut_bucket")) & F.col("__mix_cut_hash").isNotNull() & (at <= end)))
    whole = F.when(F.col("__mix_whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("__mix_whole") - 1)).otherwise(F.array().cast("array<long>"))
    epochs = F.concat(whole, F.when(partial, F.array("__mix_whole")).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("mix_epoch", F.explode(epochs))
    return rows.select(*docs.columns, "mix_domain", "mix_tokens", "mix_epoch")


def mixed_rows(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """``docs`` as often as the mix reads each row, with the columns of ``docs`` alone, whatever these are named."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    out = mixed(docs.withColumnsRenamed(own), mix)
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def oracle(mix: Mix = PRODUCTION) -> str:
    """DuckDB SQL for doc_id, domain, lang, source, tokens, epoch of ``mixed`` over the view documents."""

    def cases(column: str, names: Mapping, other) -> str:
        show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
        return f"case {' '.join(f'when {column} = {show(k)} then {show(v)}' for k, v in names.items())} else {show(other)} end" if names else show(other)

    fills, above = [], "(select cast(floor(sum(supply) * %d / 1000) as bigint) given from leaves)" % mix.share
    for depth, level in enumerate(LEVELS):
        keys, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "1"
        on = " and ".join(f"c.{k} is not distinct from p.{k}" for k in LEVELS[:depth]) or "true"
        fills.append(f"""
c{depth} as (select c.*, p.given from (select {keys}, sum(supply) * {mix.epochs} room, {cases(level, mix.weights.get(level, {}), mix.other)} weight from leaves group by {keys}) c join {above} p on {on}),
w{depth} as (select *, sum(room) over (partition by {parents} order by room::double / weight, {level} nulls first rows unbounded preceding) below, sum(weight) over (partition by {parents}) - sum(weight) over (partition by {parents} order by room::double / weight, {level} nulls first rows unbounded preceding) after from c{depth}),
f{depth} as (select *, below * weight + room * after <= given * weight filled from w{depth}),
t{depth} as (select *, sum(if(filled, room, 0)) over (partition by {parents}) taken, sum(if(filled, 0, weight)) over (partition by {parents}) open from f{depth}),
s{depth} as (select *, if(filled, room, ((given - taken) * weight) // greatest(open, 1)) share from t{depth}),
q{depth} as (select {keys}, share + if(not filled and sum(if(filled, 0, 1)) over (partition by {parents} order by {level} nulls first rows unbounded preceding) <= given - sum(share) over (partition by {parents}), 1, 0) given from s{depth})""")
        above = f"q{depth}"
    leaf = " and ".join(f"d.{k} is not distinct from l.{k}" for k in LEVELS)
    same = " and ".join(f"l.{k} is not distinct from q.{k}" for k in LEVELS)
    return f"""
with d as (select doc_id, {cases('source', mix.domain_of, mix.other_domain)} as domain, lang, source, coalesce((strlen(text) + 3) // 4, 0) tokens from documents),
leaves as (select domain, lang, source, sum(tokens) supply from d group by all),{','.join(fills)},
l as (select l.*, if(supply = 0, 0, given // greatest(supply, 1)) whole, if(supply = 0, 0, given % greatest(supply, 1)) rest from leaves l join q2 q on {same}),
h as (select d.*, l.whole, l.rest, md5('{mix.seed}:' || l.whole || ':' || coalesce(d.doc_id::varchar, 'null')) hash from d join l on {leaf}),
r as (select *, sum(tokens) over (partition by domain, lang, source order by hash, doc_id nulls first range unbounded preceding) reach from h)
select doc_id, domain, lang, source, tokens::bigint tokens, unnest(range(0, whole::bigint + if(rest > 0 and reach <= rest, 1, 0))) as epoch from r
"""
