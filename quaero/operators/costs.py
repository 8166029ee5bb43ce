"""Cost projections: usage volumes by price dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.values import prices, replies


def _cents(c: Column, n: int = 4) -> Column:
    return F.bround(c, n)


def usage(**columns: Column | str | float) -> dict[str, Column]:
    """The planning inputs as columns: the defaults, with the caller's in their place."""
    plan = {k: F.lit(v) for k, v in prices.PLAN.items()}
    plan["margin_pct"] = F.lit(None).cast("double")
    plan["chunks_indexed"] = F.lit(0)
    for name, value in columns.items():
        plan[name] = value if isinstance(value, Column) else F.lit(value)
    return plan


def _models(only: list[str] | None = None) -> Column:
    rows = [m for m in prices.LANGUAGE_MODELS if only is None or m[0] in only]
    names = ["provider", "label", "category", "input_per_m", "output_per_m"]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, m)]) for m in rows])


def _model(provider: str) -> tuple:
    known = {m[0]: m for m in prices.LANGUAGE_MODELS}
    return known.get(provider, known[prices.LANGUAGE_MODEL_FALLBACK])


def _price(table: list[tuple], key: str, default: str) -> float:
    known = {row[0]: row[2] for row in table}
    return known.get(key, known[default])


def tokens_in(plan: dict[str, Column], questions: Column) -> Column:
    return questions * (plan["avg_input_tokens"] + plan["tool_calls_per_q"] * plan["tool_extra_in"])


def tokens_out(plan: dict[str, Column], questions: Column) -> Column:
    return questions * (plan["avg_output_tokens"] + plan["tool_calls_per_q"] * plan["tool_extra_out"])


def model_cost(plan: dict[str, Column], questions: Column, input_per_m: Column, output_per_m: Column) -> Column:
    return _cents(
        tokens_in(plan, questions) / 1e6 * input_per_m + tokens_out(plan, questions) / 1e6 * output_per_m
    )


def embedding_cost(chunks: Column, tokens_per_chunk: Column, provider: str = prices.EMBEDDER_DEFAULT) -> Column:
    return _cents(chunks * tokens_per_chunk / 1e6 * _price(prices.EMBEDDERS, provider, prices.EMBEDDER_DEFAULT))


def rerank_cost(questions: Column, provider: str = prices.RERANKER_DEFAULT) -> Column:
    return _cents(questions / 1000 * _price(prices.RERANKERS, provider, prices.RERANKER_DEFAULT))


def model_bill(usage_rows: DataFrame, plan: dict[str, Column], provider: str, questions: str = "questions") -> DataFrame:
    """Tokens and dollars of a usage aggregate at one provider's prices."""
    _, label, category, per_in, per_out = _model(provider)
    q = F.col(questions)
    return usage_rows.withColumns(
        {
            "provider": F.lit(provider), "label": F.lit(label), "category": F.lit(category),
            "input_tokens": F.floor(tokens_in(plan, q)), "output_tokens": F.floor(tokens_out(plan, q)),
            "input_usd": _cents(tokens_in(plan, q) / 1e6 * per_in),
            "output_usd": _cents(tokens_out(plan, q) / 1e6 * per_out),
            "total_usd": model_cost(plan, q, F.lit(per_in), F.lit(per_out)),
        }
    )


def project(rows: DataFrame, plan: dict[str, Column], llm: str = prices.LANGUAGE_MODEL_DEFAULT,
            embedder: str = prices.EMBEDDER_DEFAULT, reranker: str = prices.RERANKER_DEFAULT) -> DataFrame:
    """Monthly totals of every usage row.

    With ``margin_pct`` the revenue follows from the margin, without it from the
    wanted profit.
    """
    _, _, _, per_in, per_out = _model(llm)
    users = plan["active_users"]
    base = rows.withColumn("_users", users.cast("long")).withColumn(
        "questions", F.bround(F.col("_users") * plan["requests_per_user_month"]).cast("long")
    )
    q = F.col("questions")
    monthly = _cents(embedding_cost(plan["chunks_indexed"], plan["avg_chunk_tokens"], embedder) * plan["monthly_refresh_share"])
    support = _cents(plan["support_hours"] * plan["support_hourly_usd"])
    base = base.withColumns(
        {
            "llm_usd": model_cost(plan, q, F.lit(per_in), F.lit(per_out)),
            "embeddings_usd": monthly, "rerank_usd": rerank_cost(q, reranker), "support_usd": support,
        }
    ).withColumns(
        {
            "variable_usd": _cents(F.col("llm_usd") + F.col("embeddings_usd") + F.col("rerank_usd")),
            "fixed_usd": _cents(plan["infra_fixed_usd"] + plan["electricity_usd"] + plan["storage_usd"]
                                + plan["bandwidth_usd"] + F.col("support_usd")),
        }
    ).withColumn("total_cost_usd", _cents(F.col("variable_usd") + F.col("fixed_usd")))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(0.95), plan["margin_pct"] / 100))
    total = F.col("total_cost_usd")
    by_margin = plan["margin_pct"].isNotNull()
    base = base.withColumn(
        "revenue_needed_usd",
        F.when(by_margin, _cents(total / (1 - margin))).otherwise(_cents(total + _cents(plan["target_profit_usd"]))),
    ).withColumn(
        "profit_usd",
        F.when(by_margin, _cents(F.col("revenue_needed_usd") - total)).otherwise(_cents(plan["target_profit_usd"])),
    )
    revenue, n = F.col("revenue_needed_usd"), F.col("_users")
    spread = F.greatest(F.lit(0.01), revenue / F.nullif(n, F.lit(0)) - F.col("variable_usd") / F.greatest(F.lit(1), n))
    fx = plan["fx_mdl"]
    return base.withColumns(
        {
            "total_cost_mdl": F.bround(total * fx), "revenue_needed_mdl": F.bround(revenue * fx),
            "profit_mdl": F.bround(F.col("profit_usd") * fx),
            "margin_realized_pct": F.coalesce(F.bround(100 * F.col("profit_usd") / F.nullif(revenue, F.lit(0.0)), 1), F.lit(0.0)),
            "price_per_user_usd": F.coalesce(_cents(revenue / F.nullif(n, F.lit(0))), F.lit(0.0)),
            "price_per_request_usd": F.coalesce(_cents(revenue / F.nullif(q, F.lit(0))), F.lit(0.0)),
            "cost_per_request_usd": F.coalesce(_cents(total / F.nullif(q, F.lit(0))), F.lit(0.0)),
            "break_even_users": F.when(
                (n > 0) & (revenue > F.col("variable_usd")), F.bround(F.col("fixed_usd") / spread).cast("long")
            ).otherwise(n),
        }
    ).withColumnRenamed("_users", "active_users")


def scenarios(projected: DataFrame, plan: dict[str, Column], keys: tuple[str, ...] = (),
              only: list[str] | None = None) -> DataFrame:
    """Every provider's total per usage row, cheapest first; the price list is part of each row."""
    listed = projected.select(
        *keys, "questions", "active_users", "embeddings_usd", "rerank_usd", "fixed_usd",
        *[c.alias(f"_{n}") for n, c in plan.items()],
        F.explode(_models(only or prices.COMPARED_MODELS)).alias("_m"),
    )
    own = {n: F.col(f"_{n}") for n in plan}
    q = F.col("questions")
    priced = listed.withColumn("llm_usd", model_cost(own, q, F.col("_m.input_per_m"), F.col("_m.output_per_m"))).withColumn(
        "stack_total_usd", _cents(F.col("llm_usd") + F.col("embeddings_usd") + F.col("rerank_usd") + F.col("fixed_usd"))
    )
    return priced.select(
        *keys, F.col("_m.provider").alias("provider"), F.col("_m.label").alias("label"), "llm_usd", "stack_total_usd",
        F.bround(F.col("stack_total_usd") * own["fx_mdl"]).alias("stack_total_mdl"),
        _cents((F.col("stack_total_usd") + own["target_profit_usd"]) / F.nullif("active_users", F.lit(0))).alias("price_per_user_usd"),
    ).orderBy(*keys, "stack_total_usd", "provider")


def sensitivity(projected: DataFrame, plan: dict[str, Column], keys: tuple[str, ...] = (),
                llm: str = prices.LANGUAGE_MODEL_DEFAULT) -> DataFrame:
    """Cost over a grid of user and request numbers around every usage row."""
    _, _, _, per_in, per_out = _model(llm)
    n, r = F.col("active_users"), F.col("_requests_per_user_month")
    users = F.array_distinct(F.array(F.greatest(F.lit(1).cast("long"), F.floor(n / 2)), n, n * 2, n * 5))
    requests = F.array_distinct(F.array(F.greatest(F.lit(1.0), r / 2), r.cast("double"), (r * 2).cast("double")))
    listed = projected.select(
        *keys, "active_users", "embeddings_usd", "rerank_usd", "fixed_usd", *[c.alias(f"_{k}") for k, c in plan.items()]
    )
    own = {k: F.col(f"_{k}") for k in plan}
    grid = listed.withColumn("users", F.explode(users)).withColumn("req_per_user", F.explode(requests)).withColumn(
        "questions", F.bround(F.col("users") * F.col("req_per_user")).cast("long")
    )
    total = _cents(model_cost(own, F.col("questions"), F.lit(per_in), F.lit(per_out)) + F.col("embeddings_usd")
                   + F.col("rerank_usd") + F.col("fixed_usd"))
    return grid.select(
        *keys, "users", "req_per_user", "questions", total.alias("total_cost_usd"),
        _cents(total / F.col("users")).alias("per_user_cost_usd"),
    )


def recommend(scenario_rows: DataFrame, keys: tuple[str, ...] = (), current: str = prices.LANGUAGE_MODEL_DEFAULT) -> DataFrame:
    """``(*keys, cheapest, saving_usd, advice)``."""
    row = F.struct("stack_total_usd", "provider", "label")
    local = prices.LANGUAGE_MODEL_LOCAL
    picked = scenario_rows.groupBy(*keys).agg(
        F.min(row).alias("_best"),
        F.max(F.when(F.col("provider") == current, row)).alias("_now"),
        F.max(F.when(F.col("provider") == local, row)).alias("_local"),
    )
    saving = _cents(F.col("_now.stack_total_usd") - F.col("_best.stack_total_usd"))
    cheaper = F.col("_now").isNotNull() & (F.col("_now.provider") != F.col("_best.provider"))
    shown = lambda c: F.col(c).cast("string")
    advice = F.concat_ws(
        " ",
        F.format_string(replies.CHEAPEST, "_best.label", shown("_best.stack_total_usd")),
        F.when(cheaper, F.format_string(replies.CHEAPER, "_now.label", saving.cast("string"), "_best.label")),
        F.when(F.col("_local").isNotNull(), F.format_string(replies.SELF_HOSTED, shown("_local.stack_total_usd"))),
    )
    return picked.select(
        *keys, F.col("_best.provider").alias("cheapest"),
        F.when(cheaper, saving).otherwise(F.lit(0.0)).alias("saving_usd"), advice.alias("advice"),
    )
