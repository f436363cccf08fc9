"""The indicator table in long form, filtered, and the summaries drawn from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.functions.scalar import clean_text, leading_year, map_values, to_number
from lossgauge.operators import clean, profile, summarize
from lossgauge.operators.enrich import attach_dimension, lookup_rename
from lossgauge.operators.ordered import GROUP_LIMIT, blocks_needed, forward_fill
from lossgauge.operators.reshape import wide_to_long
from lossgauge.plans import labels, profile_report


def prepare_indicators(indicators: DataFrame, renames: DataFrame, entities: DataFrame) -> DataFrame:
    """(country, Series Name, year, score_rank, Region, Income), gaps filled per country and series.

    The marker ``..`` becomes NULL after the fill and so is not filled.
    """
    old, new = renames.columns
    # two old names may become one: the old name settles the order of their rows
    kept = indicators.withColumn("_old", F.col("Country Name"))
    named = lookup_rename(kept, "Country Name", renames, old, new)
    narrow = named.select(
        F.col("Country Name").alias("country"), "Series Name", "_old", *[F.col(f"`{c}`") for c in labels.YEAR_COLUMNS]
    )
    long = wide_to_long(narrow, ["country", "Series Name", "_old"], list(labels.YEAR_COLUMNS), "year", "score_rank")
    long = long.withColumn("year", leading_year(F.col("year")))
    joined = attach_dimension(long, entities, "country", "Country").withColumn("_value", F.col("score_rank"))
    filled = forward_fill(
        joined,
        ["score_rank", "Region", "Income"],
        partition_by=["country", "Series Name"],
        # rows that repeat a name, series and year settle by value
        order_by=["year", "_old", "_value"],
        blocks=blocks_needed(named, ["Country Name", "Series Name"], GROUP_LIMIT // len(labels.YEAR_COLUMNS)),
    ).drop("_old", "_value")
    income = map_values(clean_text(F.col("Income")), {**labels.INCOME_LABELS, **labels.UNLABELLED_INCOME})
    return filled.withColumns(
        {
            "Income": income,
            "Region": map_values(F.col("Region"), labels.REGION_LABELS),
            "score_rank": to_number(F.col("score_rank")),
        }
    )


class IndicatorExplorer:
    """Summaries of one prepared indicator table."""

    def __init__(self, rows: DataFrame, series: str = "score"):
        self.series = series
        self.rows = rows

    def choose(
        self,
        years: tuple[int, int] | None = None,
        series: str = "score",
        series_name: str = clean.ALL,
        exact: bool = True,
        **equal: object,
    ) -> IndicatorExplorer:
        """Closed year range, score or rank, equal values; ``'All'`` stands for no filter.

        A named series narrows the rows to that series; with ``exact=False`` only to series whose name
        contains the word given in ``series``.
        """
        listed = labels.SCORE_SERIES if series == "score" else labels.RANK_SERIES
        named = series_name != clean.ALL
        rows = clean.keep_matching(self.rows, "Series Name", series) if named and not exact else self.rows
        chosen = clean.filter_panel(
            rows,
            equal={"Series Name": series_name if exact else clean.ALL, **equal},
            member={"Series Name": listed},
            between={"year": years} if years else None,
        )
        return IndicatorExplorer(chosen, series)

    def map_means(self, series_name: str = clean.ALL) -> DataFrame:
        """Mean per country; over the overall series if no other is named."""
        overall = labels.OVERALL_SCORE if self.series == "score" else labels.OVERALL_RANK
        name = overall if series_name == clean.ALL else series_name
        return summarize.mean_by(clean.filter_panel(self.rows, equal={"Series Name": name}), ["country"], ["score_rank"])

    def _categories(self, option: str, selected: Sequence[str] | None, leave_out: Sequence[str]) -> DataFrame:
        rows = clean.drop_values(self.rows, "Series Name", leave_out)
        rows = clean.replace_values(rows, "Series Name", labels.SHORT_SERIES)
        if option == "country":
            rows = clean.filter_panel(rows, member={"country": selected or []})
        return clean.drop_group(rows, option, "Nan") if option == "Income" else rows

    def line_means(
        self,
        option: str,
        selected: Sequence[str] | None = None,
        leave_out: Sequence[str] = (labels.OVERALL_SCORE,),
    ) -> DataFrame:
        """Mean per category and year without the overall series."""
        return summarize.mean_by(self._categories(option, selected, leave_out), [option, "year"], ["score_rank"])

    def boxes(
        self,
        option: str,
        selected: Sequence[str] | None = None,
        leave_out: Sequence[str] = (labels.OVERALL_SCORE,),
    ) -> DataFrame:
        return summarize.box_plot(self._categories(option, selected, leave_out), option, "score_rank")

    def profile(self) -> dict[str, DataFrame]:
        return {
            "columns": profile.profile_columns(self.rows),
            "numeric": profile.profile_numeric(self.rows),
            "frequent": profile.profile_frequent(self.rows, self.rows.columns),
            "histogram": profile.profile_histogram(self.rows),
            "correlation": profile.profile_correlation(self.rows),
            "duplicates": profile.profile_duplicates(self.rows),
        }

    def associations(self) -> dict[str, DataFrame]:
        """The rest of the profile: how columns hang together, what is missing, what texts are made of."""
        return profile_report.associations(self.rows)
