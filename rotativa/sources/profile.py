"""A study's profile as a JSON document: its settings, outlets and declared entities, with defaults for what is missing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a profile holds if nothing else is said.
DEFAULTS: dict = {"periodo": {"desde": "", "hasta": ""}, "temas": 5, "peso_minimo": 2, "ventana": 6, "calidad": {"minimo": 0.0}, "medios": {}, "entidades": [], "palabras_vacias": []}


def _filled(given: dict, defaults: dict) -> dict:
    """Defaults under the given values, group by group."""
    return defaults | {k: _filled(v, defaults[k]) if isinstance(v, dict) and isinstance(defaults.get(k), dict) and defaults[k] else v for k, v in given.items()}


def load(path: str, defaults: dict = DEFAULTS) -> dict:
    """The profile at ``path``; the defaults where there is none."""
    file = Path(path)
    return _filled(json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}, defaults)


def save(profile: dict, path: str) -> None:
    Path(path).write_text(json.dumps(profile, ensure_ascii=False, indent=1), encoding="utf-8")


def restore(path: str, defaults: dict = DEFAULTS) -> dict:
    """Put the defaults in the profile's place."""
    save(defaults, path)
    return load(path, defaults)


def outlets(spark: SparkSession, profile: dict) -> DataFrame:
    """(medio, dominio, grupo): the outlets of all groups."""
    rows = [(m.get("nombre"), m.get("dominio"), g) for g, ms in profile.get("medios", {}).items() for m in ms]
    return spark.createDataFrame(rows, "medio string, dominio string, grupo string")


def forms(spark: SparkSession, profile: dict) -> DataFrame:
    """(form, canonical, kind): every form of the declared entities, each once without regard to case."""
    rows = {}
    for e in profile.get("entidades", []):
        for form in [e.get("nombre"), *e.get("variantes", [])]:
            if form and form.strip():
                rows.setdefault((e["nombre"], form.strip().lower()), (form.strip(), e["nombre"], e.get("tipo") or "otro"))
    return spark.createDataFrame(list(rows.values()), "form string, canonical string, kind string")
