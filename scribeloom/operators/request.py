"""Request rows: the chat body a model server would get for each prompt."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeloom.functions import fixed
from scribeloom.options import RequestOptions


def provider_of(setting: Column, endpoint: Column) -> Column:
    """Provider by setting or by what the endpoint gives away."""
    # Providers and the marks of their endpoints.
    ollama = (setting == "OLLAMA") | endpoint.contains("/api/chat") | endpoint.contains(":11434")
    deepseek = (setting == "DEEPSEEK") | endpoint.contains("api.deepseek.com")
    return F.when(ollama, "OLLAMA").when(deepseek, "DEEPSEEK").otherwise("OPENAI")


def model_of(provider: Column, model: Column) -> Column:
    """Model name to send; one provider knows its own names only."""
    # Name parts that are passed on, and the name used otherwise.
    known = model.startswith("deepseek") | model.contains("chat") | model.contains("reasoner")
    return F.when((provider == "DEEPSEEK") & ~known, "deepseek-chat").otherwise(model)


def number(value: float) -> int | Decimal:
    """A number with at most four places and no needless zeros."""
    rounded = Decimal(repr(float(value))).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    return int(rounded) if rounded == rounded.to_integral_value() else rounded.normalize()


def request_body(provider: Column, model: Column, prompt: Column, options: RequestOptions) -> Column:
    """Chat body as JSON; fields a provider does not take are null and left out."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))

    user, system = message("user", prompt), message("system", F.lit(fixed.SYSTEM_MESSAGE))
    is_ollama, is_openai = provider == "OLLAMA", provider == "OPENAI"
    body = F.struct(
        F.coalesce(model, F.lit("")).alias("model"),
        F.when(is_ollama, F.array(user)).otherwise(F.array(system, user)).alias("messages"),
        F.lit(False).alias("stream"),
        F.when(is_openai, F.lit(options.max_tokens)).alias("max_tokens"),
        F.when(~is_ollama, F.lit(number(options.temperature))).alias("temperature"),
        F.when(~is_ollama, F.lit(number(options.top_p))).alias("top_p"),
    )
    return F.to_json(body, {"ignoreNullFields": "true"})


def request_rows(prompts: DataFrame, options: RequestOptions = RequestOptions()) -> DataFrame:
    """Provider, model and body for each prompt. Columns named provider_setting,
    endpoint or model on the rows go before the options."""

    def own(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)) if name in prompts.columns else F.lit(value)

    endpoint = own("endpoint", options.endpoint)
    provider = provider_of(own("provider_setting", options.provider), endpoint)
    rows = prompts.withColumns({"provider": provider, "endpoint": endpoint})
    rows = rows.withColumn("model", model_of(F.col("provider"), own("model", options.model)))
    return rows.withColumn(
        "body",
        request_body(F.col("provider"), F.col("model"), F.col("prompt"), options),
    )
