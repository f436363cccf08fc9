"""The loss table enriched and filtered, and the summaries drawn from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.functions.scalar import clean_text, map_values
from lossgauge.operators import clean, profile, stats, summarize
from lossgauge.operators.enrich import attach_dimension
from lossgauge.operators.ordered import GROUP_LIMIT, blocks_needed, forward_fill
from lossgauge.plans import labels, profile_report
from lossgauge.session import stable

FILL_ORDER = ("year", "commodity", "food_supply_stage")


def prepare_losses(
    losses: DataFrame,
    entities: DataFrame,
    commodities: DataFrame,
    *,
    names: Mapping[str, str] = labels.COUNTRY_NAMES,
    denied: Sequence[str] = labels.DENIED_AREAS,
    fill_order: Sequence[str] = FILL_ORDER,
) -> DataFrame:
    """Without duplicates, harmonised, with region, income and commodity group, gaps filled per country.

    A gap takes the last known value before it in the order of ``fill_order``.
    """
    renamed = clean.replace_values(clean.drop_duplicate_rows(losses), "country", names)
    kept = clean.drop_values(renamed, "country", denied)
    joined = attach_dimension(kept, entities, "country", "Country")
    joined = attach_dimension(joined, commodities, "commodity", "Commodities")
    order = {f"_by_{c}": F.col(c) for c in fill_order}
    # rows are distinct here, so a hash of all columns settles the order of the others
    order["_by_row"] = F.xxhash64(*[c for c in joined.columns])
    filled = forward_fill(
        joined.withColumns(order),
        [c for c in joined.columns if c != "country"],
        partition_by=["country"],
        order_by=list(order),
        # counted under the new names, as several old ones may share one
        blocks=blocks_needed(clean.replace_values(losses.select("country"), "country", names), ["country"], GROUP_LIMIT),
    ).drop(*order)
    income = map_values(clean_text(F.col("Income")), {**labels.INCOME_LABELS, **labels.UNLABELLED_INCOME})
    return filled.withColumns(
        {"Income": income, "Region": map_values(F.col("Region"), labels.REGION_LABELS)}
    )


class LossExplorer:
    """Summaries of one prepared loss table. ``choose`` narrows it; the other methods read it."""

    def __init__(self, rows: DataFrame, *, entity="country", year="year", measure="loss_percentage"):
        self.rows, self.entity, self.year, self.measure = rows, entity, year, measure

    def choose(self, years: tuple[int, int] | None = None, **equal: object) -> LossExplorer:
        """Closed year range and equal values; ``'All'`` stands for no filter."""
        between = {self.year: years} if years else None
        chosen = clean.filter_panel(self.rows, equal=equal, between=between)
        return LossExplorer(chosen, entity=self.entity, year=self.year, measure=self.measure)

    def menus(self, columns: Sequence[str]) -> DataFrame:
        return summarize.distinct_values(self.rows, columns)

    def year_range(self) -> DataFrame:
        return summarize.min_max(self.rows, [self.year])

    def map_means(self) -> DataFrame:
        return summarize.mean_by(self.rows, [self.entity], [self.measure])

    def year_means(self) -> DataFrame:
        return summarize.mean_by(self.rows, [self.year])

    def frequencies(self, option: str, top: int = 7) -> DataFrame:
        return summarize.top_with_others(clean.keep_positive(self.rows, self.measure), option, top)

    def bars(self, option: str, top: int = 7) -> DataFrame:
        """The frequencies drawn as bars: without the unlabelled group."""
        return clean.drop_group(self.frequencies(option, top), option, "Nan")

    def category_year_means(self, option: str, selected: Sequence[str]) -> DataFrame:
        chosen = clean.filter_panel(self.rows, member={option: selected})
        return summarize.mean_by(chosen, [option, self.year])

    def correlation(self, option: str, selected: Sequence[str], leave_out: Sequence[str] = ("m49_code",)) -> DataFrame:
        means = self.category_year_means(option, selected)
        others = summarize.numeric_columns(means, [option, self.year, self.measure, *leave_out])
        return stats.one_hot_correlation(
            means, category=option, measure=self.measure, selected=selected, others=others
        )

    def category_year_counts(self, option: str, selected: Sequence[str]) -> DataFrame:
        chosen = clean.filter_panel(self.rows, member={option: selected})
        return summarize.count_by(chosen, [option, self.year])

    def histogram(self, option: str, selected: Sequence[str], bins: int | None = None) -> DataFrame:
        counts = self.category_year_counts(option, selected)
        return summarize.histogram_sum(counts, x=self.year, y=self.measure, colour=option, bins=bins)

    def panels(self, option: str) -> Panels:
        """All panels of one option from a single pass over the rows."""
        return Panels(self, option)

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


class Panels:
    """The panels of a ``LossExplorer`` from one stored table of sums and counts.

    The rows are read once: grouping sets over entity, year, option, and option by year gather sums and counts of all
    columns, combined on the map side. Each panel is made from its own set, so the chosen values, the length of the top
    list and the bins can change without another pass.
    """

    def __init__(self, explorer: LossExplorer, option: str):
        self.entity, self.year, self.measure, self.option = explorer.entity, explorer.year, explorer.measure, option
        rows = explorer.rows
        self.columns = rows.columns
        self.numbers = summarize.numeric_columns(rows)
        # the option may be the entity
        sets = list(dict.fromkeys([(self.entity,), (self.year,), (option,), (option, self.year)]))
        keys = list(dict.fromkeys(k for s in sets for k in s))
        # copies, as a key that is not in a row's set is NULL there
        named = rows.select("*", *[F.col(k).alias(f"_k_{k}") for k in keys])
        part = [F.grouping(f"_k_{k}") for k in keys]
        pattern = F.concat(*[p.cast("string") for p in part])
        cube = named.groupingSets([[F.col(f"_k_{k}") for k in s] for s in sets], *[f"_k_{k}" for k in keys]).agg(
            pattern.alias("_set"),
            F.count_if(F.col(self.measure) > 0).alias("_positive"),
            *[F.sum(c).alias(f"_s_{c}") for c in self.numbers],
            *[F.count(c).alias(f"_n_{c}") for c in self.columns],
        )
        self.keys, self.cube = keys, stable(cube)

    def _of(self, *by: str) -> DataFrame:
        """The rows of one grouping set; a NULL key forms no group."""
        marks = "".join("0" if k in by else "1" for k in self.keys)
        rows = self.cube.filter(F.col("_set") == marks)
        return rows.withColumnsRenamed({f"_k_{k}": k for k in by}).dropna("any", subset=list(by))

    def _means(self, rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
        return rows.select(*by, *[F.try_divide(F.col(f"_s_{c}").cast("double"), F.col(f"_n_{c}")).alias(c) for c in columns])

    def map_means(self) -> DataFrame:
        return self._means(self._of(self.entity), [self.entity], [self.measure])

    def year_means(self) -> DataFrame:
        return self._means(self._of(self.year), [self.year], [c for c in self.numbers if c != self.year])

    def frequencies(self, top: int = 7) -> DataFrame:
        counts = self._of(self.option).select(self.option, F.col("_positive").alias("n")).filter("n > 0")
        return summarize.top_of_counts(counts, self.option, top)

    def bars(self, top: int = 7) -> DataFrame:
        return clean.drop_group(self.frequencies(top), self.option, "Nan")

    def _chosen(self, selected: Sequence[str]) -> DataFrame:
        return clean.filter_panel(self._of(self.option, self.year), member={self.option: selected})

    def category_year_means(self, selected: Sequence[str]) -> DataFrame:
        by = [self.option, self.year]
        return self._means(self._chosen(selected), by, [c for c in self.numbers if c not in by])

    def correlation(self, selected: Sequence[str], leave_out: Sequence[str] = ("m49_code",)) -> DataFrame:
        means = self.category_year_means(selected)
        others = summarize.numeric_columns(means, [self.option, self.year, self.measure, *leave_out])
        return stats.one_hot_correlation(
            means, category=self.option, measure=self.measure, selected=selected, others=others
        )

    def category_year_counts(self, selected: Sequence[str]) -> DataFrame:
        by = [self.option, self.year]
        rows = self._chosen(selected)
        return rows.select(*by, *[F.col(f"_n_{c}").alias(c) for c in self.columns if c not in by])

    def histogram(self, selected: Sequence[str], bins: int | None = None) -> DataFrame:
        counts = self.category_year_counts(selected)
        return summarize.histogram_sum(counts, x=self.year, y=self.measure, colour=self.option, bins=bins)
