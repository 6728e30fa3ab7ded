"""What a run took: totals from the written results, and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.usage import COST, COUNTS
from .operators.executor import RESULT


@dataclass(frozen=True)
class RunStats:
    rows: int
    errors: int
    retries: int
    calls: int
    seconds: float
    workers: int
    least_workers: int
    input_tokens: int
    output_tokens: int
    total_tokens: int
    reasoning_tokens: int
    search_credits: int
    search_count: int
    #: What providers say that the calls cost, None if none says so; and an error of the run, if there was one.
    cost_usd: float | None = None
    error: str | None = None

    @property
    def rows_per_minute(self) -> float:
        return self.rows / self.seconds * 60 if self.seconds else 0.0

    @property
    def tokens_per_minute(self) -> float:
        return self.total_tokens / self.seconds * 60 if self.seconds else 0.0

    def report(self, model: str, provider: str | None = None) -> str:
        """Totals, rates and search, as text; at the end a hint if workers were reduced."""
        line = "=" * 60
        out = [line, "TOKENS", line, f"Model: {model}", f"Input: {self.input_tokens:,}", f"Output: {self.output_tokens:,}"]
        out += [f"  of these reasoning: {self.reasoning_tokens:,}"] if self.reasoning_tokens else []
        out += [f"Total: {self.total_tokens:,}", f"Time: {self.seconds:.1f} s with {self.workers} workers", f"RPM: {self.rows_per_minute:.1f}", f"TPM: {self.tokens_per_minute:,.0f}"]
        if self.search_count:
            out += [f"Searches ({(provider or 'search').upper()}): {self.search_count}, credits: {self.search_credits}"]
        out += [f"Cost: ${self.cost_usd:.4f}"] if self.cost_usd is not None else []
        if self.reduced:
            out += [line, self.notice()]
        return "\n".join([*out, line])

    def notice(self) -> str:
        return f"Rate limits reduced the workers of a task to {self.least_workers}; consider parallel_requests={self.least_workers}"

    @property
    def reduced(self) -> bool:
        return 0 < self.least_workers < self.workers


def run_stats(results: DataFrame, seconds: float, workers: int, threads: int) -> RunStats:
    """Sums over a written table of results. Accumulators would count retried tasks twice."""
    r = F.col(RESULT)
    sums = [F.coalesce(F.sum(r[c]), F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "retries", "calls")]
    x = results.agg(F.count(F.lit(1)).alias("rows"), F.count_if(r["status"] == "error").alias("errors"), F.min(r["workers"]).alias("least"), F.sum(r[COST]).alias(COST), F.min(F.when(r["status"] == "error", r["error"])).alias("error"), *sums).first()
    least = x["least"] if x["least"] is not None and x["least"] < threads else workers
    return RunStats(x["rows"], x["errors"], x["retries"], x["calls"], seconds, workers, least, *[x[c] for c in COUNTS], x[COST], x["error"])


def status_counts(df: DataFrame, status: str = "_status") -> DataFrame:
    """Rows by status."""
    return df.groupBy(F.col(f"`{status}`").alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))


def cost(input_tokens: Column, output_tokens: Column, per_million_in: float, per_million_out: float) -> Column:
    """Price of tokens, to six places."""
    return F.round((input_tokens * per_million_in + output_tokens * per_million_out) / 1e6, 6)
