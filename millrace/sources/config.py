"""Configuration: header synonyms, scoring weights and supplier aliases, as values, files and small tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("part_identifier", "description", "quantity", "uom", "mfg_name", "mfg_part", "commodity")
REQUIRED = ("part_identifier", "description", "mfg_name", "mfg_part")

# The phrases that head each column.
SYNONYMS = {
    "part_identifier": ["Part Identifier", "Part No", "Part Number", "Item No", "Item Number", "Component"],
    "description": ["Description", "Desc", "Item Description"],
    "quantity": ["Quantity", "Qty", "QTY", "Qty Req"],
    "uom": ["UM", "U/M", "UoM", "Unit"],
    "mfg_name": ["Mfg Name", "Manufacturer", "Vendor", "Supplier"],
    "mfg_part": ["Mfg Part", "Manufacturer P/N", "Vendor PN", "Vendor P/N", "Supplier PN", "Supplier P/N", "MPN"],
    "commodity": ["Commodity", "Category", "Class"],
}
# Suppliers and their known spellings.
ALIASES = {
    "North Coast Components": ["North Coast Com", "North Coast", "NCC"],
    "McMaster-Carr": ["McMaster", "Mcmaster", "McMaster- Carr", "Mcmaster- Carr", "Mcmaster-Carr"],
    "Schneider Electric": ["Modicon"],
    "OMEGA Engineering": ["OMEGA", "Omega"],
    "U.S. Sensor": ["U.S. Sensor", "US Sensor", "USS"],
}


@dataclass(frozen=True)
class Weights:
    # The default weights of the part number score.
    length_min: int = 4
    length_max: int = 32
    length_in_range_reward: float = 0.50
    length_out_of_range_penalty: float = -0.40
    whitespace_penalty_per_char: float = -0.10
    whitespace_clean_token_ratio_threshold: float = 0.80
    lowercase_penalty: float = -0.10
    bad_punct_penalty_per_char: float = -0.20
    boundary_alnum_reward: float = 0.10
    min_confidence: float = 0.35


def _mapping(spark: SparkSession, path: str) -> dict:
    """The YAML mapping in a file that Spark reads; an empty file gives {}."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    raw = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if raw is None:
        return {}
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: a mapping is expected at the top level")
    return {str(k): v for k, v in raw.items()}


def read_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    raw = _mapping(spark, path)
    if unknown := sorted(set(raw) - set(COLUMNS)):
        raise ValueError(f"{path}: unknown columns {unknown}")
    for k, v in raw.items():
        if not isinstance(v, list):
            raise ValueError(f"{path}: {k} must hold a list")
    return {k: [str(x) for x in v] for k, v in raw.items()}


def read_weights(spark: SparkSession, path: str) -> Weights:
    raw, kinds = _mapping(spark, path), {f.name: type(f.default) for f in fields(Weights)}
    if unknown := sorted(set(raw) - set(kinds)):
        raise ValueError(f"{path}: unknown weights {unknown}")
    return Weights(**{k: kinds[k](v) for k, v in raw.items()})


def read_aliases(spark: SparkSession, path: str) -> dict[str, list[str]]:
    return {k: [str(x) for x in v or []] for k, v in _mapping(spark, path).items()}


def synonym_table(spark: SparkSession, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(c, ci, pi, p) for ci, (c, ps) in enumerate((synonyms or SYNONYMS).items()) for pi, p in enumerate(ps)]
    return spark.createDataFrame(rows, "column string, column_idx int, phrase_idx int, phrase string")


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """canonical, canon_idx, alias, entry: each canonical is an alias of itself, entries in the order in which later ones overwrite."""
    rows = []
    for ci, (c, names) in enumerate((ALIASES if aliases is None else aliases).items()):
        for a in [c, *names]:
            rows.append((c, ci, a, len(rows)))
    return spark.createDataFrame(rows, "canonical string, canon_idx int, alias string, entry int")


def weight_table(spark: SparkSession, weights: Weights | None = None) -> DataFrame:
    w = asdict(weights or Weights())
    return spark.createDataFrame([tuple(w.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in w.items()))
