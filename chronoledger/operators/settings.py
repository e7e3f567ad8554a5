"""Settings: the environment over a file over the defaults, each value checked.

And versions of tables: steps that bring a table of an older layout to the
present one, in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("hook", "state_db", "cron", "kanban", "gateway_log", "knowledge")

Check = Callable[[object], object]


class Unsettled(ValueError):
    """A setting has no valid value, or a table no step to the present version."""


def _number(kind: type, text: str, optional: bool = False, most: float | None = None) -> Check:
    def check(value: object) -> object:
        if optional and value is None:
            return None
        try:
            out = None if isinstance(value, bool) else kind(value)  # type: ignore[call-arg]
        except (TypeError, ValueError):
            out = None
        whole = kind is float or not isinstance(value, float) or value.is_integer()
        if out is None or not whole or not out > 0 or (most is not None and out > most):
            raise Unsettled(text)
        return out

    return check


def _flag(value: object) -> bool:
    known = {"true": True, "false": False}
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in known:
        return known[value.lower()]
    raise Unsettled("must be true or false")


def _one_of(*choices: str) -> Check:
    def check(value: object) -> object:
        if value not in choices:
            raise Unsettled("must be one of: " + ", ".join(choices))
        return value

    return check


def _file_name(value: object) -> object:
    if not isinstance(value, str) or value in ("", ".", "..") or "/" in value:
        raise Unsettled("must be a local file name")
    return value


def _json(value: object, kind: type) -> object:
    try:
        found = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        found = None
    if not isinstance(found, kind):
        raise Unsettled("must be JSON of its kind")
    return found


def _names(known: tuple[str, ...] | None) -> Check:
    def check(value: object) -> object:
        found = _json(list(value) if isinstance(value, tuple) else value, list)
        if not all(isinstance(x, str) and x for x in found):
            raise Unsettled("must be an array of names")
        if known is not None and (len(set(found)) < len(found) or not set(found) <= set(known)):
            raise Unsettled("must name each known source once at most")
        return found

    return check


def _switches(value: object) -> object:
    found = _json(value, dict)
    if not all(isinstance(v, bool) for v in found.values()) or not set(found) <= set(SOURCES):
        raise Unsettled("must map known sources to true or false")
    return found


_WHOLE, _REAL = _number(int, "must be a positive whole number"), _number(float, "must be a positive number")
_SOME_WHOLE, _SOME_REAL = _number(int, "must be a positive whole number or null", True), _number(float, "must be a positive number or null", True)

# Settings by section and key, with their defaults.
SETTINGS: dict[tuple[str, str], tuple[object, Check]] = {
    ("capture", "interval_seconds"): (15.0, _REAL),
    ("capture", "max_content_bytes"): (65_536, _WHOLE),
    ("capture", "message_roles"): (["user", "assistant", "tool"], _names(None)),
    ("capture", "required_sources"): (["hook", "state_db"], _names(SOURCES)),
    ("capture", "sources"): ({}, _switches),
    ("knowledge", "history"): ("full", _one_of("full", "latest_only")),
    ("knowledge", "max_artifact_bytes"): (8 << 20, _WHOLE),
    ("knowledge", "max_file_bytes"): (4 << 20, _WHOLE),
    ("knowledge", "max_file_count"): (256, _WHOLE),
    ("knowledge", "max_versions"): (None, _SOME_WHOLE),
    ("reconcile", "audit_interval_seconds"): (3600.0, _REAL),
    ("reconcile", "interval_seconds"): (60.0, _REAL),
    ("retention", "enabled"): (False, _flag),
    ("retention", "max_age_days"): (30, _SOME_WHOLE),
    ("retention", "max_bytes"): (None, _SOME_WHOLE),
    ("retention", "require_delivered"): (True, _flag),
    ("retention", "vacuum"): ("auto", _one_of("auto")),
    ("security", "secret_scan_baseline"): ("secret-scan-baseline.json", _file_name),
    ("security", "secret_scan_deadline_ms"): (250, _WHOLE),
    ("security", "secret_scan_enabled"): (True, _flag),
    ("security", "secret_scan_max_bytes"): (8 << 20, _WHOLE),
    ("sync", "interval_seconds"): (None, _SOME_REAL),
    ("sync", "max_batches_per_tick"): (1, _WHOLE),
    ("sync", "max_bytes"): (1 << 20, _number(int, "must be a positive whole number of at most 4194304", most=4 << 20)),
    ("sync", "max_records"): (500, _WHOLE),
}


@dataclass(frozen=True)
class Setting:
    section: str
    key: str
    value: object
    origin: str


def load(file: Mapping[str, Mapping[str, object]] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "CHRONOLEDGER_") -> list[Setting]:
    """Every setting with its value and where that is from: `environment`
    (PREFIX_SECTION_KEY; an empty text is no value), `file` or `default`.  A value
    that does not pass its check raises, by name."""
    file, environment, out = file or {}, environment or {}, []
    for (section, key), (default, check) in SETTINGS.items():
        given = environment.get(f"{prefix}{section}_{key}".upper())
        own = file.get(section, {})
        if not isinstance(own, Mapping):
            raise Unsettled(f"{section} must be an object")
        origin, raw = ("environment", given) if given else ("file", own[key]) if key in own else ("default", default)
        try:
            out.append(Setting(section, key, check(raw), origin))
        except Unsettled as e:
            raise Unsettled(f"{section}.{key} {e}") from None
    return out


def table(spark: SparkSession, settings: list[Setting]) -> DataFrame:
    """(section, key, value as JSON, origin)."""
    return spark.createDataFrame([(s.section, s.key, json.dumps(s.value, separators=(",", ":")), s.origin) for s in settings], "section string, key string, value string, origin string")


def enabled(settings: list[Setting], source: str) -> bool:
    """Whether a source is captured; sources that are not named are."""
    return _switched(settings).get(_known(source), True)


def required(settings: list[Setting], source: str) -> bool:
    """Whether a source is captured and must be healthy."""
    names = next(s.value for s in settings if (s.section, s.key) == ("capture", "required_sources"))
    return enabled(settings, source) and source in names


def _switched(settings: list[Setting]) -> Mapping[str, bool]:
    return next(s.value for s in settings if (s.section, s.key) == ("capture", "sources"))  # type: ignore[return-value]


def _known(source: str) -> str:
    if source not in SOURCES:
        raise Unsettled(f"unknown source: {source}")
    return source


Step = tuple[str, Callable[[DataFrame], DataFrame]]


def migrated(df: DataFrame, version: str, present: str, steps: Mapping[str, Step]) -> DataFrame:
    """`df` of one version brought to the present one: `steps` has the next
    version and the change for each older one.  Without a step on the way it
    raises, and nothing has happened."""
    path, at = [], version
    while at != present:
        if at not in steps or len(path) > len(steps):
            raise Unsettled(f"version {at} can't be brought to {present}")
        at, change = steps[at]
        path.append(change)
    for change in path:
        df = change(df)
    return df
