"""Fixed dimension tables, built as literal relations whose size the planner knows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Official state codes and names in display order, the whole country last.
STATES = (
    ("11", "Rondônia"),
    ("12", "Acre"),
    ("13", "Amazonas"),
    ("14", "Roraima"),
    ("15", "Pará"),
    ("16", "Amapá"),
    ("17", "Tocantins"),
    ("21", "Maranhão"),
    ("22", "Piauí"),
    ("23", "Ceará"),
    ("24", "Rio Grande do Norte"),
    ("25", "Paraíba"),
    ("26", "Pernambuco"),
    ("27", "Alagoas"),
    ("28", "Sergipe"),
    ("29", "Bahia"),
    ("31", "Minas Gerais"),
    ("32", "Espírito Santo"),
    ("33", "Rio de Janeiro"),
    ("35", "São Paulo"),
    ("41", "Paraná"),
    ("42", "Santa Catarina"),
    ("43", "Rio Grande do Sul"),
    ("50", "Mato Grosso do Sul"),
    ("51", "Mato Grosso"),
    ("52", "Goiás"),
    ("53", "Distrito Federal"),
    ("BR", "Brasil"),
)

# Labels of the sex codes in death and birth records; any other code is unknown.
SEX_LABELS = {"1": "Masculino", "2": "Feminino"}


def _literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal relation, whose size Spark knows. Values are bound as literals, never pasted into a text."""
    kinds = [field.split(" ") for field in schema.split(", ")]
    names = {f"v{i}_{j}": value for i, row in enumerate(rows) for j, value in enumerate(row)}
    values = ", ".join("(" + ", ".join(f"CAST(:v{i}_{j} AS {kind})" for j, (_, kind) in enumerate(kinds)) + ")" for i in range(len(rows)))
    bound = {k: v.item() if hasattr(v, "item") else v for k, v in names.items()}
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(name for name, _ in kinds)})", args=bound)


def geo_dim(spark: SparkSession, places: Sequence[tuple[str, str]] = STATES) -> DataFrame:
    """Code, name and display order of each place."""
    rows = [(code, name, i) for i, (code, name) in enumerate(places, 1)]
    return _literal(spark, rows, "geo_code string, geo_name string, geo_ord int")


def e_open_table(spark: SparkSession, by_sex: Mapping[str, float]) -> DataFrame:
    """Life expectancy at the start of the open age band, per sex."""
    return _literal(spark, list(by_sex.items()), "sex string, e_open double")


def e_open_levels_table(
    spark: SparkSession, levels: Mapping[str, Sequence[tuple[float, float]]]
) -> DataFrame:
    """Model life-table levels ``(ratio, e_open)`` per sex."""
    return _literal(spark, [(sex, r, e) for sex, steps in levels.items() for r, e in steps], "sex string, ratio double, e_open double")
