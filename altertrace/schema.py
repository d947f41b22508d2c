"""Column roles of an event log and the dataset bindings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.operators import events


@dataclass(frozen=True)
class LogSchema:
    """Which source columns play the four roles, and how events are ordered."""

    case: str = "case_id"
    activity: str = "activity"
    ts: str = "ts"
    outcome: str | None = "outcome"
    order: tuple[str, ...] = ("ts",)

    def canonical(self) -> dict[str, str]:
        names = {self.case: "case_id", self.activity: "activity", self.ts: "ts"}
        if self.outcome:
            names[self.outcome] = "outcome"
        return names


@dataclass(frozen=True)
class Preset:
    """Reading options, roles and clean-up of one public event log."""

    schema: LogSchema
    format: str = "csv"
    sep: str = ";"
    drop: tuple[str, ...] = ()
    max_events: int | None = None
    complete_only: bool = False
    prefixes: tuple[str, ...] = ()
    activity_rules: tuple[tuple[str, str], ...] = ()
    case_rules: tuple[tuple[str, str], ...] = ()
    amounts: tuple[str, ...] = ()
    amounts_like: str | None = None
    casts: tuple[tuple[str, str], ...] = ()
    drop_dates: bool = False
    keep: tuple[str, ...] = field(default=())

    def prepare(self, df: DataFrame, cases: DataFrame | None = None) -> DataFrame:
        """Canonical role names, then this log's filters, renamings and types; ``pos`` is the place in the case.

        An outcome may stand with the events or with the case. A log without places of its own is numbered by the order of its schema,
        and by all other columns where that ties.
        """
        roles = self.schema.canonical()
        if self.schema.outcome and self.schema.outcome not in df.columns:
            roles[f"case:{self.schema.outcome}"] = "outcome"
        df = df.withColumnsRenamed({k: v for k, v in roles.items() if k in df.columns and k != v})
        if cases is not None:
            df = events.filter_cases_by_id(df, cases.select("case_id").distinct())
        if self.complete_only and "lifecycle:transition" in df.columns:
            df = events.filter_lifecycle(df, "lifecycle:transition", "COMPLETE")
        if self.prefixes:
            df = events.filter_activity_prefix(df, self.prefixes)
        if self.activity_rules:
            df = events.normalise_names(df, "activity", self.activity_rules)
        if self.case_rules:
            df = events.normalise_names(df, "case_id", self.case_rules)
        kinds = dict(df.dtypes)
        like = [c for c, kind in kinds.items() if self.amounts_like and kind == "string" and self.amounts_like.lower() in c.lower()]
        for col in [*self.amounts, *like]:
            df = events.parse_amounts(df, col)
        df = df.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in self.casts if c in kinds})
        if self.drop_dates:
            df = df.drop(*[c for c, kind in kinds.items() if kind == "timestamp" and c != "ts"])
        if self.max_events:
            df = events.limit_case_length(df, self.max_events)
        if "pos" not in df.columns:
            order = [c for c in (roles.get(o, o) for o in self.schema.order) if c in df.columns]
            ties = [c for c, kind in df.dtypes if c not in ("case_id", *order) and not kind.startswith("map")]
            df = events.sort_events(df, "case_id", [f"`{c}`" for c in [*order, *ties]])
        if self.keep:
            df = df.select(*[c for c in (*self.keep, "pos") if c in df.columns])
        return df.drop(*self.drop)


_XES = LogSchema(case="case:concept:name", activity="concept:name", ts="time:timestamp", outcome="label")


def _csv_log(activity: str, ts: str, case: str = "Case ID", outcome: str | None = "label", order: tuple[str, ...] | None = None) -> LogSchema:
    return LogSchema(case=case, activity=activity, ts=ts, outcome=outcome, order=order or (ts,))


# Role bindings, separators, removed columns and text rules of the public logs.
PRESETS: dict[str, Preset] = {
    "bpic11": Preset(_csv_log("Activity code", "time:timestamp")),
    "production": Preset(_csv_log("Activity", "Complete Timestamp")),
    "traffic_fines": Preset(_csv_log("Activity", "Complete Timestamp")),
    "traffic_fines_short": Preset(
        _csv_log("Activity", "Complete Timestamp"),
        keep=("case_id", "activity", "outcome", "Resource", "lastSent", "notificationType", "dismissal"),
    ),
    "sepsis_outcome": Preset(_csv_log("Activity", "time:timestamp", order=("event_nr",)), drop=("event_nr",)),
    "bpic12_outcome": Preset(
        _csv_log("Activity", "Complete Timestamp"),
        complete_only=True,
        activity_rules=(("-COMPLETE", ""),),
    ),
    "dice4el": Preset(
        _csv_log("Activity", "Complete Timestamp", order=("event_nr",)),
        complete_only=True,
        activity_rules=(("-COMPLETE", ""),),
        max_events=25,
        keep=("case_id", "activity", "outcome", "event_nr", "Resource", "AMOUNT_REQ"),
    ),
    "dice4el_eval": Preset(_csv_log("activity", "Complete Timestamp", case="caseid"), sep=","),
    "rabobank": Preset(_csv_log("IncidentActivity_Type", "DateStamp", case="Incident ID", outcome=None)),
    "volvo_incidents": Preset(_XES, format="xes", drop=("org:resource",)),
    "hospital": Preset(_XES, format="xes", drop=("Activity code", "lifecycle:transition"), drop_dates=True),
    "sepsis_xes": Preset(_XES, format="xes"),
    "bpic12_xes": Preset(
        _XES,
        format="xes",
        complete_only=True,
        prefixes=("A_", "W_"),
        casts=(("case:AMOUNT_REQ", "double"),),
        drop=("org:resource", "lifecycle:transition"),
    ),
    "permit": Preset(
        _XES,
        format="xes",
        amounts_like="amount",
        drop=(
            "case:ProjectNumber",
            "case:TaskNumber",
            "case:ActivityNumber",
            "case:Activity_0",
            "case:dec_id_0",
            "case:id",
            "case:travel permit number",
            "case:DeclarationNumber_0",
            "case:OrganizationalEntity_0",
            "case:BudgetNumber",
            "case:Rfp_id_0",
            "case:Task_0",
            "case:Project_0",
            "case:Cost Type_0",
        ),
    ),
    "domestic_declarations": Preset(
        _XES,
        format="xes",
        activity_rules=(("Declaration ", "DECL "), (" by ", " "), (" ", "_")),
        case_rules=((" ", "_"),),
    ),
    "request_for_payment": Preset(
        _XES,
        format="xes",
        activity_rules=(("Request For Payment ", "RfP "), (" ", "_")),
        case_rules=(("request for ", ""), (" ", "_")),
        drop=("case:Cost Type", "case:Rfp_id", "id", "case:Project", "case:RfpNumber"),
    ),
}


def limited(name: str, max_events: int) -> Preset:
    """A preset restricted to cases of at most ``max_events`` events (25/50/75/100)."""
    return replace(PRESETS[name], max_events=max_events)


def subset(name: str, prefixes: tuple[str, ...]) -> Preset:
    """A preset restricted to activities that start with one of the prefixes."""
    return replace(PRESETS[name], prefixes=prefixes)
