"""Unit and metric dimensions: lookup tables and the native expressions that use them."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension -> units, in order; a unit belongs to the first dimension that lists it, case folded.
UNITS = {
    "concentration": ["M", "mM", "uM", "nM", "mol/L", "mmol/L", "umol/L", "mg/L", "ug/mL", "mg/mL", "g/L", "ppm", "ppb"],
    "rate": ["1/s", "1/min", "1/h", "s^-1", "min^-1", "h^-1", "%/h", "%/min", "mg/L/h", "mg/L/min", "mmol/h", "mmol/L/h", "ppm/h", "ppm h^-1", "umol/m2/s", "g/m2/day"],
    "time": ["ms", "s", "sec", "min", "h", "hr", "day", "d"],
    "cell_concentration": ["cells/mL", "cells/L", "cells/cm2", "cells/mm2", "CFU", "CFU/mL", "log CFU/mL", "MPN/mL"],
    "signal": ["a.u.", "AU", "RFU", "RLU", "OD600", "absorbance", "normalized intensity", "%", "fold", "ratio"],
    "fraction": ["%", "wt%", "mol%", "vol%", "fraction", "ratio", "fold"],
    "mass": ["pg", "ng", "ug", "mg", "g", "kg"],
    "normalized_mass": ["ug/mg", "mg/g", "g/g", "mg/mg", "mg/cm2", "ug/cm2"],
    "enzyme_activity": ["U", "IU", "U/mL", "U/mg", "IU/mL", "kat", "nkat", "umol/min"],
    "stress": ["Pa", "kPa", "MPa", "GPa"],
    "force": ["N", "mN", "uN"],
    "viscosity": ["Pa.s", "mPa.s", "cP", "m2/s"],
    "length": ["nm", "um", "mm", "cm", "m", "inch"],
    "area": ["nm2", "um2", "mm2", "cm2", "m2"],
    "volume": ["uL", "mL", "L", "cm3", "mm3"],
    "surface_area": ["m2/g", "cm2/g"],
    "temperature": ["degC", "C", "K"],
    "acidity": ["pH"],
    "electrical": ["V", "mV", "A", "mA", "uA", "Ohm", "kOhm", "S/m", "mS/cm"],
    "pressure": ["Pa", "kPa", "MPa", "bar", "atm", "psi"],
}
#: Fixed values: (term in a metric's name, dimension); the first that the name contains decides.
METRIC_RULES = [
    ("concentration", "concentration"), ("titer", "concentration"), ("rate", "rate"), ("time", "time"), ("duration", "time"),
    ("density", "cell_concentration"), ("count", "cell_concentration"), ("intensity", "signal"), ("signal", "signal"), ("response", "signal"),
    ("efficiency", "fraction"), ("ratio", "fraction"), ("fraction", "fraction"), ("percent", "fraction"), ("content", "fraction"),
    ("activity", "enzyme_activity"), ("strength", "stress"), ("modulus", "stress"), ("stress", "stress"), ("load", "force"), ("force", "force"),
    ("viscosity", "viscosity"), ("size", "length"), ("diameter", "length"), ("thickness", "length"), ("area", "area"), ("volume", "volume"),
    ("temperature", "temperature"), ("ph", "acidity"), ("conductivity", "electrical"), ("current", "electrical"), ("voltage", "electrical"), ("pressure", "pressure"),
]


#: Dimension -> terms; they decide, in order, where no rule does.
METRIC_TERMS = {
    "concentration": ["concentration", "titer", "metabolite", "product", "substrate", "lactate", "glucose", "acetate", "ethanol", "nitrate", "phosphate", "ammonia"],
    "rate": ["rate", "flux", "removal rate", "fixation rate", "growth rate", "production rate", "uptake rate"],
    "time": ["time", "duration", "lag", "half life", "response time", "retention time"],
    "cell_concentration": ["cell density", "cell count", "CFU", "MPN", "colonization", "viable count"],
    "signal": ["signal", "intensity", "fluorescence", "absorbance", "optical density", "OD600", "reporter", "response"],
    "fraction": ["fraction", "percentage", "efficiency", "yield", "viability", "survival", "retention", "removal", "degradation", "conversion", "coverage", "content"],
    "mass": ["mass", "amount", "weight", "biomass"],
    "normalized_mass": ["specific", "normalized", "content", "capacity", "loading"],
    "enzyme_activity": ["enzyme activity", "specific activity", "catalytic activity", "activity"],
    "stress": ["strength", "stress", "modulus", "stiffness", "elastic"],
    "force": ["force", "load", "peak load"],
    "viscosity": ["viscosity", "viscous"],
    "length": ["length", "diameter", "radius", "size", "pore size", "particle size", "zone", "thickness"],
    "area": ["area", "surface area", "coverage"],
    "volume": ["volume", "swelling volume"],
    "surface_area": ["BET", "surface area", "specific surface area"],
    "temperature": ["temperature", "thermal"],
    "acidity": ["pH", "acidity"],
    "electrical": ["voltage", "current", "resistance", "conductivity", "electrical"],
    "pressure": ["pressure"],
}
_FOLDS = ((" ", ""), ("*", ""), ("·", ""), ("^", ""), ("per", "/"))


def folded_unit(u: str) -> str:
    """What normal_unit makes of a unit, on the driver."""
    u = u.strip().lower()
    for a, b in _FOLDS:
        u = u.replace(a, b)
    return u


def normal_unit(c: Column) -> Column:
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for a, b in _FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: What contracts of metrics fold in units, in order; unlike the registry's folds they read both micro signs and leave '*'.
_CONTRACT_FOLDS = (("µ", "u"), ("μ", "u"), (" ", ""), ("·", ""), ("^", ""), ("per", "/"))


def contract_unit(c: Column) -> Column:
    """A unit as contracts of metrics compare it."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for a, b in _CONTRACT_FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unit_dimension(c: Column) -> Column:
    """The first dimension that lists the unit, or ''."""
    first: dict[str, str] = {}
    for dim, units in UNITS.items():
        for u in units:
            first.setdefault(folded_unit(u), dim)
    lookup = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, normal_unit(c)), F.lit(""))


def _deciding_terms() -> list[tuple[str, str]]:
    """(term, dimension) of rules, then terms, in order; a term that holds an earlier one can never decide and is left out."""
    kept: list[tuple[str, str]] = []
    for term, dim in [(t.replace("_", " "), d) for t, d in METRIC_RULES] + [(t.lower(), d) for d, terms in METRIC_TERMS.items() for t in terms]:
        if not any(t in term for t, _ in kept):
            kept.append((term, dim))
    return kept


def metric_dimension(c: Column) -> Column:
    """The dimension of the first rule whose term the name contains, else of the first dimension with a term in it, or ''."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9%]+", " "))

    def decide(name: Column) -> Column:
        out = F
        for dim, terms in groupby(_deciding_terms(), lambda x: x[1]):
            out = out.when(reduce(or_, [name.contains(t) for t, _ in terms]), dim)
        return out.otherwise("")

    # a lambda's variable: the text is made once a row, and terms are looked for until one is there
    return F.coalesce(F.get(F.transform(F.array(text), decide), F.lit(0)), F.lit(""))
