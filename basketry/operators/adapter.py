"""Declarative mapping of native feeds to the canonical contract.

A spec names the native column behind each canonical one and the transform applied to
it.  Specs are JSON files, checked when loaded and against the landed columns before any job runs; a new source is a
new file.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

# The canonical contract, in order.
CANONICAL = [
    "source_system", "source_txn_id", "txn_timestamp", "sku", "quantity", "unit_price",
    "discount_amount", "store_id", "batch_id", "ingested_at",
]
# Columns that travel beside the contract when the landed frame has them.
#: Of a record that did not fit its feed's schema: its file and its text.
RAW = ["raw_file", "raw_line"]
CARRIED = ["ingest_seq", "batch_month", *RAW]

CAD_TO_USD = 0.73


@dataclass(frozen=True)
class Spec:
    source: str
    fields: dict[str, str]  # canonical -> native
    transforms: dict[str, dict] = field(default_factory=dict)


def number(c: Column) -> Column:
    """As double; text that is no number, and NaN, give NULL."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def _datetime(c: Column, t: dict, rate: float) -> Column:
    return F.try_to_timestamp(c, F.lit(t["format"]))


def _currency_string(c: Column, t: dict, rate: float) -> Column:
    text = F.replace(c.cast("string"), F.lit(t["strip"]), F.lit("")) if t.get("strip") else c.cast("string")
    return number(F.trim(F.replace(text, F.lit(","), F.lit(""))))


def _cents(c: Column, t: dict, rate: float) -> Column:
    return number(c) / F.lit(100.0)


def _cad_to_usd(c: Column, t: dict, rate: float) -> Column:
    return number(c) * F.lit(rate)


def _unit_price(_: Column | None, t: dict, rate: float) -> Column:
    total = number(F.col(t["line_total"]))
    if t.get("currency") == "CAD":
        total = total * F.lit(rate)
    each = F.try_divide(total, number(F.col(t["quantity"])))
    return F.rint(each * 100) / F.lit(100.0)  # cents, halves to even


TRANSFORMS = {
    "datetime": _datetime,
    "currency_string": _currency_string,
    "cents": _cents,
    "cad_to_usd": _cad_to_usd,
    "unit_price_from_total": _unit_price,
}


#: Parameters of each transform that a spec must give, and those that it may give.
PARAMETERS = {
    "datetime": ({"format"}, set()),
    "currency_string": (set(), {"strip"}),
    "cents": (set(), set()),
    "cad_to_usd": (set(), set()),
    "unit_price_from_total": ({"line_total", "quantity"}, {"currency"}),
}
#: Canonical columns that a spec must produce; landing adds the others.
MAPPED = [c for c in CANONICAL if c not in ("source_system", "batch_id", "ingested_at")]


def parse_spec(text: str, name: str = "spec") -> Spec:
    """A spec from JSON (``source``, ``fields`` from canonical to native, ``transforms``); every fault is named at once."""
    faults = []
    try:
        given = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{name}: not JSON: {e}") from None
    if not isinstance(given, dict) or not isinstance(given.get("source"), str) or not given["source"]:
        raise ValueError(f"{name}: no source named")
    fields, transforms = given.get("fields", {}), given.get("transforms", {})
    if not isinstance(fields, dict) or not isinstance(transforms, dict) or not all(isinstance(t, dict) for t in transforms.values()):
        raise ValueError(f"{name}: fields and transforms are objects by canonical column")
    faults += [f"unknown key {k!r}" for k in given if k not in ("source", "fields", "transforms")]
    faults += [f"unknown column {c!r}" for c in dict.fromkeys([*fields, *transforms]) if c not in MAPPED]
    faults += [f"{c!r} needs the name of a native column" for c, native in fields.items() if not isinstance(native, str) or not native]
    for column, t in transforms.items():
        if t.get("type") not in TRANSFORMS:
            faults.append(f"unknown transform {t.get('type')!r} for {column!r}")
            continue
        needed, allowed = PARAMETERS[t["type"]]
        faults += [f"transform of {column!r} lacks {p!r}" for p in sorted(needed - t.keys())]
        faults += [f"transform of {column!r} has unknown {p!r}" for p in sorted(t.keys() - needed - allowed - {"type"})]
    made = set(fields) | {c for c, t in transforms.items() if t.get("type") == "unit_price_from_total"}
    faults += [f"no source for {c!r}" for c in MAPPED if c not in made]
    if faults:
        raise ValueError(f"{name}: " + "; ".join(faults))
    return Spec(given["source"], fields, transforms)


def load_specs(folder: str | Path) -> dict[str, Spec]:
    """The specs of a folder's JSON files by source."""
    out: dict[str, Spec] = {}
    for path in sorted(Path(folder).glob("*.json")):
        spec = parse_spec(path.read_text(encoding="utf-8"), path.name)
        if spec.source in out:
            raise ValueError(f"{path.name}: a second spec for {spec.source!r}")
        out[spec.source] = spec
    return out


SPECS = load_specs(Path(__file__).parent / "specs")


def native_columns(spec: Spec) -> set[str]:
    """Landed columns that a spec reads."""
    from_total = [t for t in spec.transforms.values() if t["type"] == "unit_price_from_total"]
    return set(spec.fields.values()) | {t[p] for t in from_total for p in ("line_total", "quantity")}


def compile_spec(spec: Spec, source: str, rate: float = CAD_TO_USD) -> dict[str, Column]:
    """Canonical column -> expression over the native columns."""
    if spec.source != source:
        raise ValueError(f"spec is for {spec.source!r}, not {source!r}")
    out = {canonical: F.col(native) for canonical, native in spec.fields.items()}
    for name, t in spec.transforms.items():
        if t["type"] not in TRANSFORMS:
            raise ValueError(f"unknown transform {t['type']!r} for {name!r}")
        out[name] = TRANSFORMS[t["type"]](out.get(name), t, rate)
    return out


def adapt(landed: DataFrame, source: str, spec: Spec | None = None, rate: float = CAD_TO_USD) -> DataFrame:
    """One landed feed in canonical shape."""
    spec = spec or SPECS[source]
    c = compile_spec(spec, source, rate)
    missing = sorted(native_columns(spec) - set(landed.columns))
    if missing:
        raise ValueError(f"{source!r} was landed without {', '.join(missing)}")
    typed = {
        "source_txn_id": c["source_txn_id"].cast("string"),
        "txn_timestamp": c["txn_timestamp"],
        "sku": c["sku"].cast("string"),
        "quantity": number(c["quantity"]),
        "unit_price": number(c["unit_price"]),
        "discount_amount": F.coalesce(number(c["discount_amount"]), F.lit(0.0)),
        "store_id": c["store_id"].cast("string"),
    }
    kept = [n for n in CARRIED if n in landed.columns]
    return landed.select(*[typed[n].alias(n) if n in typed else F.col(n) for n in CANONICAL], *kept)


def adapt_all(landed: dict[str, DataFrame], rate: float = CAD_TO_USD, specs: dict[str, Spec] | None = None) -> DataFrame:
    """Several landed feeds in canonical shape, by the specs given or the built-in ones."""
    specs = SPECS if specs is None else specs
    out = None
    for source, df in landed.items():
        if source not in specs:
            raise ValueError(f"no spec for {source!r}")
        one = adapt(df, source, specs[source], rate)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
