"""An aggregate request as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import conditions as C
from tidemark.functions import dates as D
from tidemark.functions import formulas as M
from tidemark.model import TEXT_FILTER_COLUMN, RelationSpec, Star, with_columns_or_null
from tidemark.operators.gapfill import fill_gaps
from tidemark.operators.snapshot import CONTEXT, latest_snapshot, snapshot_delta
from tidemark.operators.weighted import keep_requested_dimension_sets, time_weighted_average, weighted_aggregate

# Filter keys that steer the read instead of naming a column.
CONTROL_KEYS = ("latest_snapshot", "snapshot_delta", "snapshot_fallback_mode", "period", "debug_sql", "_")
# Plain config columns a filter may name.
PLAIN_COLUMNS = ("channel", "name")
# Channels that mix page rows, post rows and breakdown rows.
PAGE_LEVEL_CHANNELS = ("facebook_organic",)
# Group fields that live on the post level.
POST_LEVEL_FIELDS = (
    "post",
    "post_id",
    "caption",
    "message",
    "media_type",
    "permalink",
    "permalink_url",
    "timestamp",
    "created_time",
)
# Group fields that do not ask for a breakdown by dimension.
NO_BREAKDOWN_FIELDS = (
    "account_type",
    "metric_date",
    *D.GRAINS,
    "channel",
    "page",
    "page_id",
    "page_title",
    "channeled_account_id",
    "channeledaccount",
    "linked_platform_entity_id",
)
# Labels of missing members.
UNKNOWN_DIMENSION = "unknown"
WEIGHTED_UNKNOWN = "N/A"
UNKNOWN_ENTITY = "Unknown"
MISSING_ATTRIBUTE = "N/A"
# Fixed value: the formula that is the least status of the campaigns behind the facts.
CAMPAIGN_STATUS = "campaign_status"


@dataclass(frozen=True)
class AggregateRequest:
    aggregations: Mapping[str, str]
    group_by: Sequence[str] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    start_date: str | None = None
    end_date: str | None = None
    order_by: str | None = None
    order_dir: str = "ASC"
    fill_gaps: bool = False

    @property
    def channel(self) -> str | None:
        raw = self.filters.get("channel")
        if isinstance(raw, Mapping):
            raw = raw.get("value")
        return str(raw).strip().lower() or None if isinstance(raw, (str, int)) else None

    @property
    def period(self) -> str:
        return M.safe_period(self.filters.get("period"))

    def flag(self, key: str) -> bool:
        raw = self.filters.get(key, False)
        return str(raw).strip().lower() in ("1", "true", "on", "yes")


def aggregate(star: Star, request: AggregateRequest, dictionary: M.MetricDictionary | None = None) -> DataFrame:
    """Answer a request: filters, groups, measures, order, and gap filling."""
    dictionary = dictionary or M.MetricDictionary()
    names = [str(e).strip().lower() for e in request.aggregations.values()]
    if any(n in M.WEIGHTED_METRICS for n in names):
        result = _weighted(star, request, dictionary)
    elif any(_time_weighted_base(n) for n in names) and not (request.flag("latest_snapshot") or request.flag("snapshot_delta")):
        result = _time_weighted(star, request, dictionary)
    else:
        result = _conditional(star, request, dictionary)
    return _ordered(_gap_filled(result, request), request)


def aggregate_entity(df: DataFrame, request: AggregateRequest) -> DataFrame:
    """A request over any entity: expressions of its columns instead of metrics.

    Dates bound the entity's own date. Groups and filters are columns, periods,
    date parts, or ``data.x`` paths.
    """
    day = F.to_date(D.base_date_column(df.columns)) if request.start_date or request.end_date else None
    frame = df if day is None else df.filter(D.in_range(day, request.start_date, request.end_date))
    for key, raw in request.filters.items():
        if key not in CONTROL_KEYS:
            frame = frame.filter(C.predicate(_entity_field(frame, key), raw, text="." in key))
    groups = {name: _entity_field(frame, name) for name in request.group_by}
    measures = [M.aggregate_expression(t, frame.columns).alias(a) for a, t in request.aggregations.items()]
    result = frame.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(*measures)
    return _ordered(_gap_filled(result, request), request)


def _entity_field(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(name)
    source, dot, path = name.partition(".")
    if dot and source in df.columns:
        return F.get_json_object(source, "$." + path)
    day = F.to_date(D.base_date_column(df.columns))
    if name == "daily":
        return day
    return D.grain_label(day, name) if name in D.GRAINS else D.date_part(day, name)


def filtered_facts(star: Star, request: AggregateRequest, with_dates: bool = True) -> DataFrame:
    """Facts within the request's dates and filters."""
    frame = star.frame(request.start_date, request.end_date) if with_dates else star.frame()
    return _filtered(_scoped(frame, star, request), star, request)


# --- filters ---------------------------------------------------------------


def _filtered(frame: DataFrame, star: Star, request: AggregateRequest, text_first: bool = False) -> DataFrame:
    for key, raw in request.filters.items():
        if key not in CONTROL_KEYS:
            frame = _one_filter(frame, star, key, raw, text_first)
    return frame


def _one_filter(frame: DataFrame, star: Star, key: str, raw: Any, text_first: bool) -> DataFrame:
    if key in PLAIN_COLUMNS:
        return frame.filter(C.predicate(F.col(key), raw, text=True))
    if key == "account_type":
        return _account_type(frame, star, raw)
    if key in ("post", "post_id"):
        return _post_filter(frame, star, raw)
    spec = star.relations.get(key) or star.relations.get(key.removesuffix("_id"))
    if spec is not None and not key.startswith("dimensions."):
        return _relation_filter(frame, star, key, spec, raw, text_first)
    if key.endswith("_id") and key in frame.columns:
        return frame.filter(C.id_predicate(F.col(key), raw))
    return frame.filter(C.predicate(dimension(key), raw, text=True))


def _relation_filter(frame: DataFrame, star: Star, key: str, spec: RelationSpec, raw: Any, text_first: bool) -> DataFrame:
    fk = F.col(spec.fk)
    cond = C.parse_condition(raw)
    if cond.operator in ("is_null", "is_not_null") and not spec.attribute:
        return frame.filter(C.predicate(fk, cond))
    if spec.attribute:
        labels = star.entity(spec.table).select(F.col("id").alias("__id"), spec.label_of(star.entity(spec.table)).alias("__label"))
        joined = frame.join(labels, fk == F.col("__id"), "left")
        return joined.filter(C.predicate(F.col("__label"), cond, text=True)).drop("__id", "__label")
    numeric = all(C._is_integer(v) for v in cond.items if v not in C.NULL_WORDS)
    if spec.by_text and (text_first or not numeric):
        return _text_filter(frame, star, key, spec, cond)
    return frame.filter(C.id_predicate(fk, cond))


def _text_filter(frame: DataFrame, star: Star, key: str, spec: RelationSpec, cond: C.Condition) -> DataFrame:
    """Entities are filtered first, so the join carries matching keys only."""
    entity = star.entity(spec.table)
    column = TEXT_FILTER_COLUMN.get(key, spec.label)
    column = column if column in entity.columns else spec.label
    fk = F.col(spec.fk)
    texts = [str(v) for v in cond.items if v not in C.NULL_WORDS]
    wants_null = any(v in C.NULL_WORDS for v in cond.items)
    negative = cond.operator in ("neq", "not_in")
    if not texts:
        return frame.filter((fk.isNotNull() if negative else fk.isNull()) if wants_null else F.lit(False))
    match = F.col(column).like(texts[0]) if cond.operator == "like" else F.col(column).isin(texts)
    ids = entity.filter(match).select(F.col("id").alias("__id")).distinct()
    if negative:
        return frame.filter(fk.isNotNull()).join(ids, fk == F.col("__id"), "left_anti")
    if not wants_null:
        return frame.join(ids, fk == F.col("__id"), "left_semi")
    joined = frame.join(ids, fk == F.col("__id"), "left")
    return joined.filter(fk.isNull() | F.col("__id").isNotNull()).drop("__id")


def _account_type(frame: DataFrame, star: Star, raw: Any) -> DataFrame:
    fk = F.col("channeled_account_id")
    cond = C.parse_condition(raw)
    if cond.operator in ("is_null", "is_not_null"):
        return frame.filter(C.predicate(fk, cond))
    accounts = star.entity("channeled_accounts")
    ids = accounts.filter(F.lower("type") == F.lit(str(cond.value).lower())).select(F.col("id").alias("__id"))
    return frame.join(ids, fk == F.col("__id"), "left_semi")


def _post_filter(frame: DataFrame, star: Star, raw: Any) -> DataFrame:
    """Platform ids are looked up in the posts; surrogate keys compare directly."""
    fk = F.col("post_id")
    if not C.is_platform_post_id(raw):
        return frame.filter(C.id_predicate(fk, raw))
    posts = star.entity("posts").filter(C.predicate(F.col("post_id"), raw, text=True))
    return frame.join(posts.select(F.col("id").alias("__id")), fk == F.col("__id"), "left_semi")


def _scoped(frame: DataFrame, star: Star, request: AggregateRequest) -> DataFrame:
    """On channels that mix levels, read page rows and totals unless asked otherwise."""
    if request.channel not in PAGE_LEVEL_CHANNELS:
        return frame
    post_filter = str(request.filters.get("post", "")).strip().upper()
    post_level = post_filter not in ("", "NULL", "N/A") or any(
        g.strip().lower() in POST_LEVEL_FIELDS for g in request.group_by
    )
    if post_level:
        return frame
    frame = frame.filter(F.col("post_id").isNull())
    if not _asks_breakdown(star, request):
        frame = frame.filter(F.col("dimension_set_id").isNull())
    return frame


def _asks_breakdown(star: Star, request: AggregateRequest) -> bool:
    relations = {k.lower() for k in star.relations}
    for raw in request.group_by:
        name = raw.strip().lower()
        known = name in NO_BREAKDOWN_FIELDS or name in relations or name.removesuffix("_id") in relations
        if name and not known:
            return True
    for key, value in request.filters.items():
        empty = value is None or value == [] or (isinstance(value, str) and not value.strip())
        if key.strip().lower().startswith("dimensions.") and not empty:
            return True
    return False


# --- groups ----------------------------------------------------------------


def dimension(key: str) -> Column:
    """Value of a free-form dimension; pages fall back to the landing page."""
    name = key.removeprefix("dimensions.").lower()
    value = F.try_element_at("dims", F.lit(name))
    return F.coalesce(value, F.try_element_at("dims", F.lit("landing_page"))) if name == "page" else value


@dataclass
class _Groups:
    """Columns to group by, and labels to look up once the groups are formed.

    A label depends on its key alone, so it is joined to the few result rows
    rather than to every fact. Likewise ``periods`` are grouped by their first
    day and spelled out in the result.
    """

    keys: dict[str, Column] = field(default_factory=dict)
    labels: list[tuple[str, RelationSpec]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    periods: list[str] = field(default_factory=list)

    def add(self, name: str, column: Column) -> None:
        self.keys[name] = column
        self.columns.append(name)


def _groups(frame: DataFrame, star: Star, request: AggregateRequest, unknown: str) -> tuple[_Groups, DataFrame]:
    out = _Groups()
    day = F.col(D.base_date_column(frame.columns))
    for name in request.group_by:
        if name in D.DAILY_NAMES:
            out.add(name, day)
        elif name in D.GRAINS:
            out.add(name, D.grain_start(day, name))
            out.periods.append(name)
        elif name in D.DATE_PARTS:
            out.add(name, D.date_part(day, name))
        elif name in PLAIN_COLUMNS or (name.endswith("_id") and name in frame.columns):
            out.add(name, F.col(name))
        elif name == "account_type":
            accounts = star.entity("channeled_accounts").select(
                F.col("id").alias("__acc"), F.col("type").alias("__type")
            )
            frame = frame.join(accounts, F.col("channeled_account_id") == F.col("__acc"), "left").drop("__acc")
            out.add(name, F.col("__type"))
        elif name in star.relations:
            spec = star.relations[name]
            if spec.attribute:
                entity = star.entity(spec.table)
                labels = entity.select(F.col("id").alias(f"__id_{name}"), spec.label_of(entity).alias(f"__label_{name}"))
                frame = frame.join(labels, F.col(spec.fk) == F.col(f"__id_{name}"), "left").drop(f"__id_{name}")
                out.add(name, F.coalesce(F.col(f"__label_{name}"), F.lit(MISSING_ATTRIBUTE)))
            else:
                if spec.required:
                    ids = star.entity(spec.table).select(F.col("id").alias("__id"))
                    frame = frame.join(ids, F.col(spec.fk) == F.col("__id"), "left_semi")
                out.keys[f"{name}_id"] = F.col(spec.fk)
                out.labels.append((name, spec))
                out.columns += [name, f"{name}_id"]
        elif any(name.partition(".")[2].startswith(p) for p in ("data.", "metadata.")):
            relation, _, path = name.partition(".")
            spec, source = star.relations[relation], path.partition(".")[0]
            values = star.entity(spec.table).select(
                F.col("id").alias("__jid"),
                F.get_json_object(source, "$." + path.partition(".")[2]).alias(f"__json_{len(out.columns)}"),
            )
            frame = frame.join(values, F.col(spec.fk) == F.col("__jid"), "left").drop("__jid")
            out.add(name, F.col(f"__json_{len(out.columns)}"))
        elif name.startswith(("metadata.", "data.")):
            source, _, path = name.partition(".")
            out.add(name, F.get_json_object(source, "$." + path))
        else:
            out.add(name, F.coalesce(dimension(name), F.lit(unknown)))
    return out, frame


def _with_labels(result: DataFrame, star: Star, groups: _Groups, measures: Sequence[str]) -> DataFrame:
    for name, spec in groups.labels:
        entity = star.entity(spec.table)
        key = F.col(f"{name}_id")
        labels = entity.select(F.col("id").alias("__id"), spec.label_of(entity).alias("__label"))
        missing = (
            F.lit(MISSING_ATTRIBUTE) if spec.json_path else F.coalesce(key.cast("string"), F.lit(UNKNOWN_ENTITY))
        )
        result = (
            result.join(labels, key == F.col("__id"), "left")
            .withColumn(name, F.coalesce("__label", missing))
            .drop("__id", "__label")
        )
    return _with_period_names(result.select(*[f"`{c}`" for c in [*groups.columns, *measures]]), groups)


def _with_period_names(result: DataFrame, groups: _Groups) -> DataFrame:
    for name in groups.periods:
        result = result.withColumn(name, D.grain_label(F.col(name), name))
    return result


# --- measures --------------------------------------------------------------


def measure(
    text: str, star: Star, request: AggregateRequest, facts: M.FactColumns, dictionary: M.MetricDictionary, columns: Sequence[str]
) -> Column:
    """The aggregate a requested name or expression stands for."""
    name = text.strip().lower()
    if name in star.formulas:
        return star.formulas[name](F.col("value"))
    if name == CAMPAIGN_STATUS:
        return F.min("__campaign_status")
    M.refuse_raw_value(text)
    organic_period = _organic_period(request)
    found = dictionary.expression(name, request.channel, facts, "marketing")
    if found is None:
        found = dictionary.expression(name, request.channel, facts, "organic", organic_period, request.flag("latest_snapshot"))
    if found is None:
        found = M.library_formula(name, facts, request.period)
    if found is None:
        found = M.named_sum(name, facts, request.period)
    if found is None:
        found = M.aggregate_expression(text, columns)
    return found


def _contexts(star: Star, request: AggregateRequest) -> DataFrame:
    """Facts the snapshot dates are looked up in: all facts of the contexts asked for.

    Filters on what makes up a context leave whole contexts out and are applied;
    filters on anything else would hide dates and are not.
    """
    kept = {}
    for key, raw in request.filters.items():
        spec = star.relations.get(key) or star.relations.get(key.removesuffix("_id"))
        column = spec.fk if spec is not None else key
        if key.startswith("dimensions.") or (column in CONTEXT and key not in CONTROL_KEYS):
            kept[key] = raw
    return _filtered(star.frame(), star, replace(request, filters=kept))


def _joins_first(name: str, star: Star) -> bool:
    """Whether a group field is an attribute that several keys may share."""
    if name == "account_type":
        return True
    relation, dot, _ = name.partition(".")
    return relation in star.relations and (bool(dot) or star.relations[relation].attribute)


def _reduced(frame: DataFrame, star: Star, request: AggregateRequest) -> DataFrame:
    """Facts summed per key and metric, before attributes of the keys are joined.

    Grouping by an attribute needs the join before the groups are known. Summing
    by the keys first leaves one row per key, metric and period for that join.
    """
    day = F.col("metric_date")
    temporal = [n for n in request.group_by if n in (*D.GRAINS, *D.DATE_PARTS, *D.DAILY_NAMES)]
    keys: dict[str, Column] = {"name": F.col("name"), "period": F.col("period")}
    dims: list[str] = []
    for name in request.group_by:
        relation = name.partition(".")[0]
        if name in temporal or name in keys:
            continue
        if name == "account_type":
            keys["channeled_account_id"] = F.col("channeled_account_id")
        elif name in PLAIN_COLUMNS or (name.endswith("_id") and name in frame.columns):
            keys[name] = F.col(name)
        elif relation in star.relations:
            fk = star.relations[relation].fk
            keys[fk] = F.col(fk)
        elif relation in ("data", "metadata"):
            return _as_partials(frame)
        else:
            dims.append(name.removeprefix("dimensions.").lower())
    if temporal:
        one_grain = len(temporal) == 1 and temporal[0] in D.GRAINS
        keys["metric_date"] = D.grain_start(day, temporal[0]) if one_grain else day
    values = {f"__d{i}": dimension(d) for i, d in enumerate(dims)}
    grouped = frame.groupBy(*[c.alias(n) for n, c in {**keys, **values}.items()]).agg(
        F.sum("value").alias("value_sum"), F.count("value").alias("value_count"), F.max("value").alias("value_max")
    )
    pairs = [part for i, d in enumerate(dims) for part in (F.lit(d), F.col(f"__d{i}"))]
    rebuilt = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return with_columns_or_null(grouped.withColumn("dims", rebuilt).drop(*values), {"metric_date": "date"})


def _as_partials(frame: DataFrame) -> DataFrame:
    value = F.col("value")
    return frame.withColumns({"value_sum": value, "value_count": F.when(value.isNotNull(), 1), "value_max": value})


def _by_name(text: str, star: Star) -> bool:
    """Whether a measure reads facts by metric name only."""
    name = text.strip().lower()
    return name.isidentifier() and name not in star.formulas and name != CAMPAIGN_STATUS


def _organic_period(request: AggregateRequest) -> str:
    if request.filters.get("period"):
        return request.period
    post_level = any(g.strip().lower() in POST_LEVEL_FIELDS for g in request.group_by)
    return "lifetime" if request.flag("latest_snapshot") or post_level else "daily"


def _conditional(star: Star, request: AggregateRequest, dictionary: M.MetricDictionary) -> DataFrame:
    latest, delta = request.flag("latest_snapshot"), request.flag("snapshot_delta")
    if latest and delta:
        raise ValueError("latest_snapshot and snapshot_delta cannot be used together")
    mode = str(request.filters.get("snapshot_fallback_mode", "resilient")).lower()
    snapshot = latest or delta
    if not snapshot and _can_presum(star, request):
        return _presummed(star, request, dictionary)
    frame = filtered_facts(star, request, with_dates=not snapshot)
    if latest:
        frame = latest_snapshot(frame, request.start_date, request.end_date, mode, source=_contexts(star, request))
    elif delta:
        frame = snapshot_delta(frame, request.start_date, request.end_date, mode, source=_contexts(star, request))
    total = not request.group_by and not snapshot
    facts = M.FactColumns(empty_as_zero=total)
    by_name = all(_by_name(t, star) for t in request.aggregations.values())
    if by_name and not snapshot and any(_joins_first(n, star) for n in request.group_by):
        frame, facts = _reduced(frame, star, request), M.partial_columns()
    if any(t.strip().lower() == CAMPAIGN_STATUS for t in request.aggregations.values()):
        spec = star.relations["channeledCampaign"]
        status = star.entity(spec.table).select(F.col("id").alias("__cid"), F.col("status").alias("__campaign_status"))
        frame = frame.join(status, F.col(spec.fk) == F.col("__cid"), "left").drop("__cid")
    groups, frame = _groups(frame, star, request, UNKNOWN_DIMENSION)
    measures = {a: measure(t, star, request, facts, dictionary, frame.columns) for a, t in request.aggregations.items()}
    if total and by_name:
        # Facts of other metrics add nothing to a total, so they need not be joined.
        frame = frame.filter(facts.name.isin(sorted(facts.asked)))
    if snapshot:
        measures["snapshot_effective_date"] = F.max("metric_date")
    keys = [c.alias(k) for k, c in groups.keys.items()]
    result = frame.groupBy(*keys).agg(*[c.alias(a) for a, c in measures.items()])
    return _with_labels(result, star, groups, list(measures))


def _can_presum(star: Star, request: AggregateRequest) -> bool:
    """Whether to sum facts per config before the config join, whatever their sizes.

    Summing first shrinks what the join shuffles, and a config that holds a large
    share of the facts arrives as one row per period. A config has about one fact a
    day, so for groups by day there is nothing to sum first; expressions over
    columns of the facts need the facts themselves.
    """
    if star.facts is not None or not all(_by_name(t, star) for t in request.aggregations.values()):
        return False
    if any(n in (*D.DAILY_NAMES, "day") for n in request.group_by):
        return False
    needed = {*request.group_by, *request.filters} - {"metric_config_id", *D.GRAINS, *D.DATE_PARTS}
    return not any(n.startswith(("metadata.", "data.")) or n in star.metrics.columns for n in needed)


def _presummed(star: Star, request: AggregateRequest, dictionary: M.MetricDictionary) -> DataFrame:
    day = F.col("metric_date")
    temporal = {n: D.grain_start(day, n) for n in request.group_by if n in D.GRAINS and n != "daily"}
    temporal |= {n: D.date_part(day, n) for n in request.group_by if n in D.DATE_PARTS}
    partial = (
        star.dated(star.metrics, request.start_date, request.end_date)
        .groupBy("metric_config_id", *[c.alias(f"__t_{n}") for n, c in temporal.items()])
        .agg(F.sum("value").alias("value_sum"), F.count("value").alias("value_count"), F.max("value").alias("value_max"))
    )
    configs = star.config_frame().withColumnRenamed("id", "metric_config_id")
    total = not request.group_by
    facts = M.partial_columns(empty_as_zero=total)
    measures = {a: measure(t, star, request, facts, dictionary, []) for a, t in request.aggregations.items()}
    if total:
        configs = configs.filter(facts.name.isin(sorted(facts.asked)))
    frame = partial.join(configs, "metric_config_id", "inner")
    # The date stands in for the period columns only while group keys are formed.
    frame = frame.withColumn("metric_date", F.lit(None).cast("date"))
    frame = _filtered(_scoped(frame, star, request), star, request)
    groups, frame = _groups(frame, star, request, UNKNOWN_DIMENSION)
    for name in temporal:
        groups.keys[name] = F.col(f"__t_{name}")
    keys = [c.alias(k) for k, c in groups.keys.items()]
    result = frame.groupBy(*keys).agg(*[c.alias(a) for a, c in measures.items()])
    return _with_labels(result, star, groups, list(measures))


def _known_sets(star: Star) -> DataFrame:
    """Dimensions that occur, from the smallest table that has them: facts are a last resort."""
    if star.dimension_sets is not None:
        return star.dimension_sets
    if star.configs is not None:
        return star.config_frame().select("dims")
    return with_columns_or_null(star.facts, {"dims": "map<string,string>"}).select("dims")


def _weighted(star: Star, request: AggregateRequest, dictionary: M.MetricDictionary) -> DataFrame:
    frame = star.frame(request.start_date, request.end_date)
    frame = with_columns_or_null(frame, {"dims": "map<string,string>", "dimension_set_id": "string"})
    frame = _filtered(frame, star, request, text_first=True)
    requested = [n.removeprefix("dimensions.") for n in request.group_by if n.startswith("dimensions.")]
    requested += [k.removeprefix("dimensions.") for k in request.filters if k.startswith("dimensions.")]
    frame = keep_requested_dimension_sets(frame, requested, _known_sets(star))
    groups, frame = _groups(frame, star, request, WEIGHTED_UNKNOWN)

    def relabel(summed: DataFrame) -> DataFrame:
        """Entity groups merge by label alone here, with one label for missing ones."""
        for name, spec in groups.labels:
            entity = star.entity(spec.table)
            labels = entity.select(F.col("id").alias("__id"), spec.label_of(entity).alias("__label"))
            summed = (
                summed.join(labels, F.col(f"{name}_id") == F.col("__id"), "left")
                .withColumn(name, F.coalesce("__label", F.lit(WEIGHTED_UNKNOWN)))
                .drop("__id", "__label")
            )
        kept = set(request.group_by)
        return summed.drop(*[f"{name}_id" for name, _ in groups.labels if f"{name}_id" not in kept])

    merge = relabel if groups.labels else None
    result = weighted_aggregate(frame, request.aggregations, groups.keys, dictionary, request.channel, merge)
    return _with_period_names(result.select(*[f"`{c}`" for c in [*request.group_by, *request.aggregations]]), groups)


def _time_weighted_base(name: str) -> str | None:
    base = name.removesuffix("_daily")
    return base if base in M.TIME_WEIGHTED_METRICS else None


def _time_weighted(star: Star, request: AggregateRequest, dictionary: M.MetricDictionary) -> DataFrame:
    """Averages weighted by what they averaged over, beside the other measures.

    The answers are stacked and aligned by their groups, so they need no join.
    """
    averages = {a: t.strip().lower() for a, t in request.aggregations.items() if _time_weighted_base(t.strip().lower())}
    rest = {a: t for a, t in request.aggregations.items() if a not in averages}
    answers = [_conditional(star, replace(request, aggregations=rest), dictionary)] if rest else []
    groups, frame = _groups(filtered_facts(star, request), star, request, UNKNOWN_DIMENSION)
    for alias, name in averages.items():
        base = _time_weighted_base(name)
        period = "daily" if name.endswith("_daily") else _organic_period(request)
        pair = [[n, f"{n}_daily"] for n in (base, M.TIME_WEIGHTED_METRICS[base])]
        summed = time_weighted_average(frame, *pair, groups.keys, alias, period)
        answers.append(_with_labels(summed, star, groups, [alias]))
    stacked = answers[0]
    for answer in answers[1:]:
        stacked = stacked.unionByName(answer, allowMissingColumns=True)
    keys = [c for c in stacked.columns if c not in request.aggregations]
    merged = stacked.groupBy(*[f"`{k}`" for k in keys]).agg(*[F.max(f"`{a}`").alias(a) for a in request.aggregations])
    return merged.select(*[f"`{c}`" for c in [*keys, *request.aggregations]])


# --- result ----------------------------------------------------------------


def _gap_filled(result: DataFrame, request: AggregateRequest) -> DataFrame:
    field_name = next((n for n in request.group_by if n in D.GRAINS or n == "metric_date"), None)
    if not request.fill_gaps or field_name is None or not (request.start_date and request.end_date):
        return result
    measures = [c for c in result.columns if c in request.aggregations]
    groups = [c for c in result.columns if c not in measures and c not in (field_name, "snapshot_effective_date")]
    grain = "daily" if field_name in D.DAILY_NAMES else field_name
    return fill_gaps(result, field_name, grain, request.start_date, request.end_date, measures, groups)


def _ordered(result: DataFrame, request: AggregateRequest) -> DataFrame:
    """Order by an output column, whatever its case; unknown names are ignored."""
    by_name = {c.lower(): c for c in result.columns}
    found = by_name.get((request.order_by or "").strip().lower())
    if found is None:
        return result
    column = F.col(f"`{found}`")
    return result.orderBy(column.desc() if request.order_dir.strip().upper() == "DESC" else column.asc())


def hide_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def page_of(df: DataFrame, order: Sequence[Column | str], limit: int = 100, page: int = 0) -> DataFrame:
    """One page of a listing; ``limit`` rows from ``page * limit`` on."""
    return df.orderBy(*order).offset(page * limit).limit(limit)
