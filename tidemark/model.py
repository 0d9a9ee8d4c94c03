"""The metric star: facts, what each fact measures, and the related entities."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D


@dataclass(frozen=True)
class RelationSpec:
    """How a request key reaches an entity table through a config foreign key."""

    table: str
    fk: str
    label: str
    json_path: str | None = None
    attribute: bool = False
    by_text: bool = False
    required: bool = False

    def label_of(self, frame: DataFrame) -> Column:
        column = F.col(f"`{self.label}`")
        return F.get_json_object(column, "$." + self.json_path) if self.json_path else column.cast("string")


# Request keys known out of the box.
RELATIONS: dict[str, RelationSpec] = {
    "query": RelationSpec("queries", "query_id", "query", by_text=True),
    "channeledAccount": RelationSpec("channeled_accounts", "channeled_account_id", "name"),
    "account": RelationSpec("channeled_accounts", "channeled_account_id", "name"),
    "page": RelationSpec("pages", "page_id", "url"),
    "campaign": RelationSpec("channeled_campaigns", "channeled_campaign_id", "data", json_path="name"),
    "channeled_account_id": RelationSpec("channeled_accounts", "channeled_account_id", "id"),
    "channeledCampaign": RelationSpec("channeled_campaigns", "channeled_campaign_id", "data", json_path="name"),
    "adGroup": RelationSpec("channeled_ad_groups", "channeled_ad_group_id", "name"),
    "ad": RelationSpec("channeled_ads", "channeled_ad_id", "name"),
    "creative": RelationSpec("creatives", "creative_id", "name"),
    "country": RelationSpec("countries", "country_id", "name", by_text=True),
    "device": RelationSpec("devices", "device_id", "type", by_text=True),
    "page_title": RelationSpec("pages", "page_id", "title", attribute=True),
    "page_platform_id": RelationSpec("pages", "page_id", "platform_id", attribute=True),
    "event": RelationSpec("events", "event_id", "name"),
}
# The column a text filter on these entities compares.
TEXT_FILTER_COLUMN = {"country": "code", "device": "type", "query": "query"}

# Foreign keys of a metric config.
CONFIG_KEYS = (
    "account_id",
    "channeled_account_id",
    "campaign_id",
    "channeled_campaign_id",
    "channeled_ad_group_id",
    "channeled_ad_id",
    "creative_id",
    "event_id",
    "channeled_event_id",
    "page_id",
    "query_id",
    "post_id",
    "product_id",
    "customer_id",
    "order_id",
    "country_id",
    "device_id",
    "dimension_set_id",
    "location_id",
    "state_id",
    "city_id",
)

Formula = Callable[[Column], Column]


@dataclass(frozen=True)
class Star:
    """Either joined ``facts`` or the three normal tables they come from.

    ``facts`` has one row per metric value with the config columns beside it. The
    free-form dimensions stand beside them as ``dims map<string,string>``, or in
    ``dimension_sets`` under the facts' ``dimension_set_id``. Facts that are stored
    by month carry it as a number in ``month_column``; every date bound then bounds
    the months too, so other folders are not read.
    """

    facts: DataFrame | None = None
    metrics: DataFrame | None = None
    configs: DataFrame | None = None
    dimension_sets: DataFrame | None = None
    entities: Mapping[str, DataFrame] = field(default_factory=dict)
    relations: Mapping[str, RelationSpec] = field(default_factory=lambda: dict(RELATIONS))
    formulas: Mapping[str, Formula] = field(default_factory=dict)
    month_column: str = "month"

    def register_relation(self, key: str, spec: RelationSpec, frame: DataFrame | None = None) -> Star:
        entities = ChainMap({spec.table: frame}, self.entities) if frame is not None else self.entities
        return replace(self, relations={**self.relations, key: spec}, entities=entities)

    def register_formula(self, name: str, formula: Formula | str) -> Star:
        """Add a named aggregate: a function of the value column, or SQL text.

        The text may use ``{value}`` for the value column and any fact column.
        """
        if isinstance(formula, str):
            text = formula.replace("{value}", "value")

            def formula(value, _text=text):
                return F.expr(_text)

        return replace(self, formulas={**self.formulas, name.lower(): formula})

    def config_frame(self) -> DataFrame:
        """Configs with their dimensions as a map."""
        return self._with_dimensions(self.configs)

    def _with_dimensions(self, frame: DataFrame) -> DataFrame:
        if self.dimension_sets is None or "dims" in frame.columns:
            return frame
        return frame.join(self.dimension_sets.select("dimension_set_id", "dims"), "dimension_set_id", "left")

    def dated(self, facts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """Facts of a date range, in the months of the range if they are stored by month."""
        facts = facts.filter(D.in_range(F.col(D.base_date_column(facts.columns)), start, end))
        if self.month_column not in facts.columns:
            return facts
        month = F.col(self.month_column)
        if start is not None:
            facts = facts.filter(month >= F.lit(D.month_number(start)))
        if end is not None:
            facts = facts.filter(month <= F.lit(D.month_number(end)))
        return facts.drop(self.month_column)

    def frame(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Facts of a date range joined to their configs.

        Neither side is forced into a broadcast: Spark's own size check picks
        the strategy, from plan statistics and again from real sizes at run time.
        """
        if self.facts is not None:
            return self._with_dimensions(self.dated(self.facts, start, end))
        configs = self.config_frame().withColumnRenamed("id", "metric_config_id")
        return self.dated(self.metrics, start, end).join(configs, "metric_config_id", "inner")

    def entity(self, table: str) -> DataFrame:
        if table not in self.entities:
            raise KeyError(f"no entity table {table!r} in this star")
        return self.entities[table]


def with_columns_or_null(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Add missing columns as typed NULLs, so sparse facts fit every request."""
    missing = [n for n in names if n not in df.columns]
    return df.select("*", *[F.lit(None).cast(names[n]).alias(n) for n in missing]) if missing else df
