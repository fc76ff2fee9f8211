"""The order-line pipeline as one batch plan: ladder, lookups, dedupe, rollup, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.contract import Contract
from rowgate.operators.flow import rank_in_key, text_lookup
from rowgate.operators.ladder import Rule, alerts, consistency, ladder, order_rules, rejected, typed
from rowgate.operators.rollup import orders


@dataclass
class Batch:
    """What one batch of lines became. ``decided`` has every input line, with a reason where it was rejected."""

    decided: DataFrame
    items: DataFrame
    rejects: DataFrame
    orders: DataFrame
    alerts: DataFrame


def with_references(lines: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Lines with ``known_sku``, ``known_customer`` and the references' columns (category, catalog_price, country, segment where given)."""
    product = [c for c in ("category", "catalog_price") if c in products.columns]
    person = [c for c in ("country", "segment") if c in customers.columns]
    out = text_lookup(lines, products, (F.trim("sku"), "sku"), product, "known_sku")
    return text_lookup(out, customers, (F.trim("customer_id"), "customer_id"), person, "known_customer")


def judge(known: DataFrame, contract: Contract, as_of_ms: int, strict: Column | None = None) -> DataFrame:
    """Every raw line that has its references' marks (``with_references``) with its first reason, or null."""
    return ladder(typed(known), _rules(known, contract, as_of_ms, strict))


def judge_clean(known: DataFrame, contract: Contract, as_of_ms: int, strict: Column | None = None) -> DataFrame:
    """The lines of ``judge`` that no rule rejects, with a null reason.

    Each rule is a filter of its own, so Spark applies those that need the columns of one table before it deals that for a join.
    """
    out = typed(known)
    for rule in _rules(known, contract, as_of_ms, strict):
        out = out.filter(~F.coalesce(rule.fails, F.lit(False)))
    return ladder(out, [])


def judge_each(known: DataFrame, contracts: dict[str, Contract], as_of_ms: int) -> DataFrame:
    """The same under several contracts, in one scan: ``reason_`` and the contract's name."""
    out = typed(known)
    for name, contract in contracts.items():
        out = ladder(out, _rules(known, contract, as_of_ms, None)).withColumnRenamed("reason", f"reason_{name}").drop("detail")
    return out


def judge_changed(known: DataFrame, changed: Column, products: DataFrame, customers: DataFrame, contract: Contract, as_of_ms: int) -> DataFrame:
    """``judge`` for lines of which some were ``changed`` after their references were looked up: those alone are looked up again.

    The lines are read twice, so write them first.
    """
    found = [c for c in ("category", "catalog_price", "country", "segment") if c in known.columns]
    again = with_references(known.filter(changed).drop("known_sku", "known_customer", *found), products, customers)
    return judge(known.filter(~changed).unionByName(again.select(*known.columns)), contract, as_of_ms)


def decide(lines: DataFrame, products: DataFrame, customers: DataFrame, contract: Contract, as_of_ms: int, strict: Column | None = None) -> DataFrame:
    """Every raw line with its first reason, or null; lines that are no records count as PARSE_ERROR."""
    return judge(with_references(lines, products, customers), contract, as_of_ms, strict)


def _rules(lines: DataFrame, contract: Contract, as_of_ms: int, strict: Column | None) -> list[Rule]:
    rules = order_rules(contract, as_of_ms, F.col("known_sku"), F.col("known_customer"), strict)
    if "parse_status" in lines.columns:
        unread = [
            Rule("READER_FAILURE", F.col("parse_status") == "READER_FAILURE", F.lit("the file has a line that can't be read")),
            Rule("PARSE_ERROR", F.col("parse_status") == "PARSE_ERROR", F.col("parse_error")),
        ]
        rules = unread + rules
    return rules


def clean_keys(outcome: DataFrame) -> DataFrame:
    """``order_id``, ``line_no`` of the lines without a reason, as they will be loaded, each once."""
    return outcome.filter(F.col("reason").isNull()).select(F.col("__o").alias("order_id"), F.col("__l").cast("bigint").alias("line_no"))


def outcomes(judged: DataFrame, order: tuple[str, ...], loaded: DataFrame | None = None, clean_only: bool = False, dealt: str | None = None) -> DataFrame:
    """Judged lines, each once, with DUP_KEY where a clean line isn't the first of its key or ``loaded`` has the key.

    ``__o`` and ``__l`` are the key of a clean line. One deal by order serves the choice of the first line and whatever is
    grouped by ``__o`` later; rejected lines have no part in it and are spread by a hash. With ``clean_only`` there are none.
    ``dealt`` is a column that lines of an order share and that they are dealt by already (by a join, say): then they stay where
    they are. ``loaded`` must have it, too.
    """
    if clean_only:
        judged = judged.filter(F.col("reason").isNull())
    good = F.lit(True) if clean_only else F.col("reason").isNull()
    spread = F.concat(F.lit("\x01"), F.xxhash64(*order, "order_id", "line_no").cast("string"))
    key = F.when(good, F.trim("order_id"))
    keyed = judged.withColumns({"__o": key if dealt else key.otherwise(spread), "__l": F.when(good, F.col("line_no_v"))})
    # sorted by a number first: texts that start alike are dear to tell apart
    keyed = (keyed if dealt else keyed.repartition("__o")).withColumn("__h", F.xxhash64("__o", "__l"))
    ranked = rank_in_key(keyed, [*([dealt] if dealt else []), "__h", "__o", "__l"], list(order), "__n").drop("__h")
    again = F.col("__n") > 1
    if loaded is not None and dealt:
        # an order's keys in one row, so that the lines meet them where they are
        mine = F.struct(F.col("order_id").alias("o"), F.col("line_no").cast("bigint").alias("l"))
        known = loaded.groupBy(F.col(dealt).alias("__d")).agg(F.collect_set(mine).alias("__keys"))
        own = F.struct(F.col("__o").alias("o"), F.col("__l").cast("bigint").alias("l"))
        ranked = ranked.join(known, F.col(dealt) == F.col("__d"), "left").withColumn("__seen", F.array_contains("__keys", own)).drop("__d", "__keys")
        again = again | F.coalesce("__seen", F.lit(False))
    elif loaded is not None:
        known = loaded.select(F.col("order_id").alias("__o"), F.col("line_no").alias("__l"), F.lit(True).alias("__seen")).distinct()
        ranked = ranked.join(known, ["__o", "__l"], "left")
        again = again | F.coalesce("__seen", F.lit(False))
    number = F.col("__l").cast("string")
    return ranked.withColumns(
        {
            "reason": F.when(good & again, "DUP_KEY").otherwise(F.col("reason")),
            "detail": F.when(good & again, F.concat("__o", F.lit("#"), number)).otherwise(F.col("detail")),
            "order_id": F.when(good, F.col("__o")).otherwise(F.col("order_id")),
            "line_no": F.when(good, number).otherwise(F.col("line_no")),
        }
    ).drop("__n", "__seen")


def replays(outcome: DataFrame, loaded: DataFrame) -> DataFrame:
    """``outcomes`` with DUP_KEY where a line that would load has one of the keys (each once) that are ``loaded``."""
    known = loaded.select(F.col("order_id").alias("__o"), F.col("line_no").cast("int").alias("__l"), F.lit(True).alias("__seen"))
    again = F.col("reason").isNull() & F.col("__seen").isNotNull()
    marked = outcome.join(known, ["__o", "__l"], "left").withColumn("__again", again).drop("__seen")
    detail = F.concat("__o", F.lit("#"), F.col("__l").cast("string"))
    return marked.withColumns({"reason": F.when(F.col("__again"), "DUP_KEY").otherwise(F.col("reason")), "detail": F.when(F.col("__again"), detail).otherwise(F.col("detail"))}).drop("__again")


def outcomes_each(judged: DataFrame, names: tuple[str, ...], order: tuple[str, ...], dealt: str) -> DataFrame:
    """Lines of ``judge_each``, each once, with a struct ``run_`` and its name for every contract: what ``outcomes`` says, without details.

    The lines stay where ``dealt`` put them, so one deal serves all contracts.
    """
    out = judged
    for name in names:
        own = out.withColumns({"reason": F.col(f"reason_{name}"), "detail": F.lit(None).cast("string"), "__order": F.col("order_id"), "__line": F.col("line_no")})
        run = F.struct("reason", "order_id", "line_no", "__o", "__l").alias(f"run_{name}")
        out = outcomes(own, order, dealt=dealt).select(*(c for c in out.columns if c not in ("order_id", "line_no", f"reason_{name}")), F.col("__order").alias("order_id"), F.col("__line").alias("line_no"), run)
    return out.drop("order_id", "line_no")


def items_of(outcome: DataFrame, dealt: str | None = None) -> DataFrame:
    """The lines that load, typed, with ``quality_status``, ``defects`` and the right total where it isn't quantity times price."""
    first = outcome.filter(F.col("reason").isNull())
    named = ("status", "channel", "payment_type", "category", "catalog_price", "country", "segment", "batch_id", "source_file")
    items = first.select(
        F.col("__o").alias("order_id"),
        F.col("__l").cast("int").alias("line_no"),
        F.trim("customer_id").alias("customer_id"),
        F.upper(F.trim("sku")).alias("sku"),
        F.col("qty_v").alias("qty"),
        F.col("price_v").cast("decimal(14,4)").alias("unit_price"),
        F.col("total_v").cast("decimal(14,2)").alias("line_total"),
        F.col("ts_v").alias("order_ts"),
        *(c for c in named if c in first.columns),
        *([dealt] if dealt else []),
        F.upper(F.trim("currency")).alias("currency"),
    )
    return consistency(items, "qty", "unit_price", "line_total")


def split(outcome: DataFrame, contract: Contract, clean: DataFrame | None = None, dealt: str | None = None) -> Batch:
    """A batch from its outcomes; ``clean`` has those of clean lines alone, if that is cheaper to have than to filter."""
    decided = outcome.drop("__o", "__l")
    items = items_of(outcome if clean is None else clean, dealt)
    return Batch(decided, items, rejected(decided), orders(items, dealt=dealt), alerts(items, contract))


def process(
    lines: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    contract: Contract,
    as_of_ms: int,
    loaded: DataFrame | None = None,
    order: tuple[str, ...] = ("source_file", "source_line_no"),
) -> Batch:
    """One batch. ``loaded`` has the keys of all batches before it: lines with one of them are DUP_KEY.

    Each output is a plan of its own with one scan of the lines. Where several are needed, keep ``outcomes`` and ``split`` it.
    """
    return process_judged(decide(lines, products, customers, contract, as_of_ms), contract, loaded, order)


def process_judged(
    judged: DataFrame, contract: Contract, loaded: DataFrame | None = None, order: tuple[str, ...] = ("source_file", "source_line_no"), dealt: str | None = None, clean: DataFrame | None = None
) -> Batch:
    """``process`` for lines that are judged already; ``clean`` has those without a reason (``judge_clean``), if that is cheaper to have than to filter."""
    first = outcomes(judged if clean is None else clean, order, loaded, clean_only=True, dealt=dealt)
    return split(outcomes(judged, order, loaded, dealt=dealt), contract, first, dealt)
