"""Planning rules: diameters, prices, clearances, penalties and score weights, as Python values, dimension tables and Columns.

A rules document (JSON) may replace the defaults; another kind of network is a matter of data alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nominal diameter, capacity in t/h, longest run in m, price of a new metre, price of a rebuilt metre, width in m, height in m.
DIAMETERS = (
    (50, 3.5, 181, 74023, 96180, 0.400, 0.125),
    (65, 8.3, 245, 78631, 109989, 0.430, 0.140),
    (80, 13.2, 327, 83530, 117582, 0.470, 0.160),
    (100, 22.3, 419, 89748, 133694, 0.510, 0.180),
    (125, 40.2, 554, 97275, 148030, 0.600, 0.225),
    (150, 65.1, 696, 105507, 152295, 0.650, 0.250),
    (200, 152.3, 1042, 120275, 181766, 0.880, 0.315),
    (250, 274.9, 1379, 135323, 202030, 1.050, 0.400),
    (300, 437.4, 1718, 150022, 228707, 1.150, 0.450),
    (400, 943.1, 2477, 190299, 271317, 1.370, 0.560),
    (500, 1663.4, 3245, 224137, 333884, 1.670, 0.710),
    (600, 2627.7, 4037, 264790, 372703, 1.850, 0.800),
    (700, 3735.1, 4775, 324298, 439571, 2.050, 0.900),
    (800, 5296.8, 5644, 325996, 489918, 2.250, 1.000),
    (900, 7165.0, 6518, 327693, 553607, 2.450, 1.100),
    (1000, 9391.8, 7419, 418777, 606679, 2.650, 1.200),
    (1200, 15012.8, 9288, 428074, 825692, 3.100, 1.425),
    (1400, 22501.9, 11276, 683417, 978584, 3.450, 1.600),
)
#: Smallest and largest diameter of a chamber class and its price.
CHAMBERS = ((50, 200, 3_000_000), (250, 500, 5_000_000), (600, 1000, 8_000_000), (1200, 1400, 12_000_000))
#: Rule, clearance tiers (largest diameter, m), smallest angle, margin, cost factor, half width, by restriction type.
RESTRICTIONS = {
    "oks_existing": ("forbid", ((400, 5.0), (800, 7.0), (1400, 9.0)), None, None, None, None),
    "park": ("forbid", ((1400, 1.0),), None, None, None, None),
    "social_area": ("forbid", ((1400, 1.0),), None, None, None, None),
    "prohibited_site": ("forbid", ((1400, 1.0),), None, None, None, None),
    "water": ("forbid", ((1400, 1.0),), None, None, None, None),
    "road": ("special", ((1400, 1.5),), 45.0, 3.0, 1.60, None),
    "tram_tracks": ("special", ((1400, 1.5),), 45.0, 3.0, 1.75, None),
    "gas_pipeline": ("special", ((1400, 2.0),), None, 2.0, 1.25, 0.2),
    "power_cable": ("special", ((1400, 2.0),), None, 2.0, 1.15, 0.1),
    "heat_network": ("special", ((1400, 1.0),), None, 2.0, 1.05, None),
    "metro": ("forbid", ((1400, 10.0),), None, None, None, None),
    "railway": ("forbid", ((1400, 1.0),), None, None, None, None),
    "water_supply": ("special", ((1400, 1.5),), None, 2.0, 1.10, 0.0),
    "sewer": ("special", ((1400, 1.0),), None, 2.0, 1.10, 0.0),
    "power_line_support": ("forbid", ((1400, 2.0),), None, None, None, None),
    "_fallback": ("forbid", ((1400, 1.0),), None, None, None, None),
}
#: Depth mode: normal and smallest depth, steepest slope, extra cost per metre; per crossed type top, height and clearance; smallest depth under a surface.
DEPTH = {"normal_m": 3.0, "min_m": 0.7, "max_slope": 0.10, "k_per_m": 0.10}
DEPTH_CROSSINGS = {"gas_pipeline": (2.8, 0.40, 0.2), "power_cable": (2.7, 0.20, 0.5), "heat_network": (3.0, None, 0.5), "sewer": (3.5, 0.40, 0.2)}
DEPTH_COVER = {"road": 1.0, "tram_tracks": 1.2}


@dataclass(frozen=True)
class Rules:
    diameters: tuple = DIAMETERS
    chambers: tuple = CHAMBERS
    restrictions: dict = field(default_factory=lambda: RESTRICTIONS)
    # Prices, distances, penalties and score weights.
    tie_in_cost: int = 5_000_000
    chamber_distance_m: float = 10.0
    chamber_segments: int = 4
    penalty_fixed: int = 100_000_000
    penalty_per_tph: int = 500_000
    cost_base: int = 25_000_000
    length_base_m: int = 100
    w_cost: float = 0.7
    w_length: float = 0.3

    @classmethod
    def from_json(cls, text: str) -> Rules:
        """Rules from a document; what it leaves out keeps its default. A restriction's rule is forbid or special."""
        doc = json.loads(text)
        given: dict = {}
        if "diameters" in doc:
            given["diameters"] = tuple(sorted(tuple(d[k] for k in ("dn", "capacity_tph", "max_length_m", "new_rub_m", "recon_rub_m", "width_m", "height_m")) for d in doc["diameters"]))
        if "chamber_cost" in doc:
            given["chambers"] = tuple((c["dn_min"], c["dn_max"], c["cost"]) for c in doc["chamber_cost"])
        if "restrictions" in doc:
            largest = max(d[0] for d in given.get("diameters", DIAMETERS))
            kinds = {}
            for name, r in doc["restrictions"].items():
                if r["rule"] not in ("forbid", "special"):
                    raise ValueError(f"restriction {name}: rule must be forbid or special, not {r['rule']!r}")
                tiers = r["clearance_m"]
                tiers = ((largest, float(tiers)),) if isinstance(tiers, int | float) else tuple(sorted((t["dn_max"], float(t["m"])) for t in tiers))
                kinds[name] = (r["rule"], tiers, r.get("min_angle_deg"), r.get("margin_m"), r.get("k_special"), r.get("half_width_m"))
            if "_fallback" not in kinds:
                raise ValueError("restrictions need a _fallback entry")
            given["restrictions"] = kinds
        for key, at in (("tie_in_cost", ("tie_in_cost",)), ("chamber_distance_m", ("chamber_rule", "max_dist_m")), ("chamber_segments", ("chamber_rule", "max_segments")), ("penalty_fixed", ("penalty", "fixed")), ("penalty_per_tph", ("penalty", "per_tph")), ("cost_base", ("score", "cost_base")), ("length_base_m", ("score", "length_base_m")), ("w_cost", ("score", "w_cost")), ("w_length", ("score", "w_length"))):
            value = reduce(lambda d, k: d.get(k, {}) if isinstance(d, dict) else {}, at, doc)
            if value != {}:
                given[key] = value
        return cls(**given)

    # --- dimension tables

    def diameter_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.diameters), "dn int, capacity_tph double, max_length_m int, new_rub_m int, recon_rub_m int, width_m double, height_m double")

    def restriction_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r[0], [list(t) for t in r[1]], *r[2:]) for k, r in self.restrictions.items()]
        return spark.createDataFrame(rows, "restriction_type string, rule string, clearance array<struct<dn_max:int,m:double>>, min_angle_deg double, margin_m double, k_special double, half_width_m double")

    # --- step lookups, compiled to one Column each: no join, no shuffle

    def _first(self, test, value) -> Column:
        """value of the first diameter that passes the test, null if none does."""
        return F.coalesce(*[F.when(test(d), F.lit(value(d))) for d in self.diameters])

    def diameter_for_flow(self, flow: Column) -> Column:
        """The smallest diameter whose capacity, inclusive, carries the flow."""
        return self._first(lambda d: flow <= d[1], lambda d: d[0])

    def diameter_for_length(self, length: Column) -> Column:
        """The smallest diameter whose longest run reaches the length."""
        return self._first(lambda d: length <= d[2], lambda d: d[0])

    def next_diameter(self, dn: Column) -> Column:
        """The next larger diameter, null after the largest."""
        return self._first(lambda d: dn < d[0], lambda d: d[0])

    def snap_up(self, dn: Column) -> Column:
        """A diameter of the table at least as large; beyond the table, its largest."""
        return F.when(dn.isNotNull(), F.coalesce(self._first(lambda d: dn <= d[0], lambda d: d[0]), F.lit(self.diameters[-1][0])))

    def price_per_metre(self, dn: Column) -> Column:
        return self._first(lambda d: dn == d[0], lambda d: d[3])

    def width(self, dn: Column) -> Column:
        return self._first(lambda d: dn == d[0], lambda d: d[5])

    def height(self, dn: Column) -> Column:
        return self._first(lambda d: dn == d[0], lambda d: d[6])

    def longest_run(self, dn: Column) -> Column:
        return self._first(lambda d: dn == d[0], lambda d: d[2])

    def chamber_price(self, dn: Column) -> Column:
        return F.coalesce(*[F.when(dn.between(low, high), F.lit(cost)) for low, high, cost in self.chambers])

    def restriction(self, kind: Column, column: str) -> Column:
        """One attribute of a restriction type (rule, min_angle_deg, margin_m, k_special, half_width_m); unknown types take the fallback's."""
        at = {"rule": 0, "min_angle_deg": 2, "margin_m": 3, "k_special": 4, "half_width_m": 5}[column]
        found = F.lit(self.restrictions["_fallback"][at])
        for name, r in self.restrictions.items():
            if not name.startswith("_"):
                found = F.when(kind == name, F.lit(r[at])).otherwise(found)
        return found

    def clearance(self, kind: Column, dn: Column) -> Column:
        """Clearance in metres of a pipe from a restriction: the first tier whose largest diameter, inclusive, holds dn."""
        tier = lambda r: F.coalesce(*[F.when(dn <= top, F.lit(m)) for top, m in r[1]])
        found = tier(self.restrictions["_fallback"])
        for name, r in self.restrictions.items():
            if not name.startswith("_"):
                found = F.when(kind == name, tier(r)).otherwise(found)
        return found

    # --- money

    def segment_cost(self, length: Column, dn: Column, k: Column) -> Column:
        """round2(round2(length) * price * k)."""
        return half_up(half_up(length, 2) * self.price_per_metre(dn) * k, 2)

    def penalty(self, flow: Column) -> Column:
        return F.lit(self.penalty_fixed) + flow * self.penalty_per_tph

    def score(self, cost: Column, length: Column) -> Column:
        """Weighted cost and length in units of their bases, to four digits; the lower, the better."""
        return half_up(self.w_cost * cost / self.cost_base + self.w_length * length / self.length_base_m, 4)


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, negative ones too."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))
