"""The risk ladder and the impact-assessment rule over three-valued facts, as columns.

Facts are a map from names to booleans: a name that is absent is unknown, which is neither true nor false. Every rule is an
expression over one row, so a batch of systems is classified without a shuffle; rules' texts are data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import normalised

# Fixed values of the regulation's rules.
ROOT = "eu-ai-act"
#: flag -> (point of Article 5(1), the fact that lifts the ban, its lifting value)
PROHIBITED = {
    "subliminal_or_manipulative": ("a", "causes_significant_harm", False),
    "exploits_vulnerabilities": ("b", "causes_significant_harm", False),
    "social_scoring": ("c", "social_score_detrimental_treatment", False),
    "predictive_policing_profiling": ("d", "supports_human_assessment_on_verifiable_facts", True),
    "facial_image_scraping": ("e", None, None),
    "emotion_recognition_workplace_or_education": ("f", "emotion_recognition_medical_or_safety", True),
    "biometric_categorisation": ("g", "biometric_categorisation_lawful_or_law_enforcement", True),
}
REMOTE, POLICE, REMOTE_LIFT = "real_time_remote_biometric_public", "law_enforcement_use", "rtrb_strictly_necessary_authorised"
#: point of Annex III -> (flags, further flags, domains)
HIGH_RISK = {
    1: (("biometric_identification", "emotion_recognition", REMOTE), (), ()),
    2: (("critical_infrastructure_safety",), (), ("critical_infrastructure",)),
    3: (("education_scoring_or_access",), (), ("education",)),
    4: (("employment_decisions",), (), ("employment",)),
    5: (("essential_services_access",), ("creditworthiness_evaluation", "life_health_insurance_risk_pricing"), ("healthcare", "banking", "insurance")),
    6: ((POLICE,), (), ("law_enforcement",)),
    7: (("migration_asylum_border_use",), (), ("migration",)),
    8: (("justice_democratic_use",), (), ("justice",)),
}
DEROGATIONS = ("preparatory_or_narrow_procedural_task", "improves_previous_human_activity", "detects_patterns_without_replacing_human_assessment")
TRANSPARENCY = {"interacts_with_natural_persons": 1, "generates_synthetic_content": 2, "emotion_recognition": 3}
SYSTEM_TRIGGERS = {"creditworthiness_evaluation": "b", "life_health_insurance_risk_pricing": "c"}
DEPLOYER_TRIGGERS = ("body_governed_by_public_law", "private_entity_providing_public_services")
CATEGORIES = ("prohibited", "high_risk", "transparency_only", "minimal_or_none", "uncertain")

_BANS = (*PROHIBITED, REMOTE)
_RISKS = tuple(dict.fromkeys(f for flags, more, _ in HIGH_RISK.values() for f in (*flags, *more) if f not in _BANS))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


class Facts:
    """True, false and unknown of a map column; a null map knows nothing."""

    def __init__(self, column: str):
        self.map = F.coalesce(F.col(column), F.create_map().cast("map<string,boolean>"))

    def yes(self, name: str) -> Column:
        return self.map[name].eqNullSafe(F.lit(True))

    def no(self, name: str) -> Column:
        return self.map[name].eqNullSafe(F.lit(False))

    def unknown(self, name: str) -> Column:
        return self.map[name].isNull()


def _listed(entries: list[tuple[Column, str]]) -> Column:
    """The texts of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in entries]), lambda x: x.isNotNull())


def points(flags: Facts, domain: Column) -> dict[int, Column]:
    """For each point of Annex III whether it matches; a domain alone yields if every main flag of the point is false."""
    out = {}
    for point, (main, more, domains) in HIGH_RISK.items():
        by_flag = _any([flags.yes(f) for f in (*main, *more)])
        by_domain = F.coalesce(domain.isin(*domains), F.lit(False)) if domains else F.lit(False)
        out[point] = by_flag | (by_domain & ~_all([flags.no(f) for f in main]))
    return out


def classify(systems: DataFrame, flags: str = "flags", domain: str = "domain", autonomy: str = "autonomy", deployer: str = "deployer") -> DataFrame:
    """systems with risk_category, status, confidence, annex_iii_category, article_6_3_exception_candidate, cited, missing, fria."""
    f, d = Facts(flags), Facts(deployer)
    area = normalised(F.col(domain))
    hits, pending = [], []
    for flag, (point, lift, value) in PROHIBITED.items():
        lifted = F.lit(False) if lift is None else (f.yes(lift) if value else f.no(lift))
        open_ = F.lit(False) if lift is None else f.unknown(lift)
        hits.append((f.yes(flag) & ~lifted & ~open_, f"{ROOT}:article-5:paragraph-1:point-{point}"))
        if lift is not None:
            pending.append((f.yes(flag) & open_, f"flags.{lift}"))
    both = f.yes(REMOTE) & f.yes(POLICE)
    hits.append((both & f.no(REMOTE_LIFT), f"{ROOT}:article-5:paragraph-1:point-h"))
    pending.append((both & f.unknown(REMOTE_LIFT), f"flags.{REMOTE_LIFT}"))
    pending.append((f.yes(REMOTE) & f.unknown(POLICE), f"flags.{POLICE}"))
    banned = _any([c for c, _ in hits])
    open_ban = _any([f.unknown(x) for x in _BANS]) | _any([c for c, _ in pending])
    open_risk = _any([f.unknown(x) for x in _RISKS])

    product, third = "annex_i_covered_product", "third_party_conformity_assessment_required"
    embedded = f.yes(product) & f.yes(third)
    open_product = (f.yes(product) & f.unknown(third)) | (f.yes("medical_or_safety_component") & f.unknown(product))
    matched = points(f, area)
    annex = _any(list(matched.values()))
    first = F.coalesce(*[F.when(c, F.lit(f"{ROOT}:annex-iii:point-{p}")) for p, c in matched.items()])
    derogated = (f.yes(DEROGATIONS[0]) & F.col(autonomy).eqNullSafe(F.lit("advisory"))) | _any([f.yes(x) for x in DEROGATIONS[1:]])
    candidate = derogated & ~f.yes("profiling_of_natural_persons")
    shown = _any([f.yes(x) for x in TRANSPARENCY])

    category = (
        F.when(banned, "prohibited").when(embedded | annex, "high_risk").when(open_product, "uncertain")
        .when(shown, "transparency_only").when(open_ban | open_risk, "uncertain").otherwise("minimal_or_none")
    )
    review = F.when(banned, False).when(embedded, open_ban).when(annex, candidate | open_ban).when(open_product, True).when(shown, open_ban | open_risk).otherwise(open_ban | open_risk)
    status = F.when(review, "requires_human_review").when(category == "minimal_or_none", "not_applicable").otherwise("potentially_applicable")
    by_annex = ~banned & ~embedded & annex
    article_6 = f"{ROOT}:article-6:paragraph-"
    cited = F.when(banned, _listed(hits)).when(embedded, F.array(F.lit(article_6 + "1"), F.lit(f"{ROOT}:annex-i")))
    cited = cited.when(annex, F.array_compact(F.array(F.when(f.yes(product) & f.no(third), F.lit(article_6 + "1")), first, F.lit(article_6 + "2"), F.when(candidate, F.lit(article_6 + "3")))))
    cited = cited.when(open_product, F.array(F.lit(article_6 + "1")))
    cited = cited.when(shown, _listed([(f.yes(product) & f.no(third), article_6 + "1"), *((f.yes(x), f"{ROOT}:article-50:paragraph-{n}") for x, n in TRANSPARENCY.items())])).otherwise(F.array().cast("array<string>"))
    missing = F.array_distinct(F.concat(_listed([(f.unknown(x), f"flags.{x}") for x in _BANS]), _listed([(f.unknown(x), f"flags.{x}") for x in _RISKS]), _listed(pending), _listed([(~banned & f.yes(product) & f.unknown(third), f"flags.{third}"), (by_annex & candidate & f.unknown("profiling_of_natural_persons"), "flags.profiling_of_natural_persons")])))

    # the impact assessment of Article 27(1): only point 2 of Annex III is excepted, and only for what falls under nothing else
    others = _any([c for p, c in matched.items() if p != 2])
    open_trigger = _any([f.unknown(x) for x in SYSTEM_TRIGGERS])
    open_deployer = _any([d.unknown(x) for x in DEPLOYER_TRIGGERS])
    fria = (
        F.when(category == "uncertain", "unknown").when(category != "high_risk", "does_not_apply")
        .when(~annex, F.when(open_trigger, "unknown").otherwise("does_not_apply"))
        .when(candidate | review, "unknown").when(_any([f.yes(x) for x in SYSTEM_TRIGGERS]), "applies")
        .when(~others, F.when(open_trigger, "unknown").otherwise("does_not_apply"))
        .when(_any([d.yes(x) for x in DEPLOYER_TRIGGERS]), "applies")
        .when(open_trigger | open_deployer, "unknown").otherwise("does_not_apply")
    )
    return systems.select(
        "*", category.alias("risk_category"), status.alias("status"), F.when(review, 0.5).otherwise(1.0).alias("confidence"),
        F.when(by_annex, first).alias("annex_iii_category"), (by_annex & candidate).alias("article_6_3_exception_candidate"),
        cited.alias("cited"), missing.alias("missing"), fria.alias("fria"),
    )


def cleaned(flags: Column, known: list[str]) -> Column:
    """Only known facts with a value."""
    return F.map_filter(flags, lambda k, v: k.isin(*known) & v.isNotNull())


def changed(flags: Column, names: list[str], value: bool | None) -> Column:
    """Facts with `names` set to value, or made unknown."""
    rest = F.map_filter(flags, lambda k, v: ~k.isin(*names))
    return rest if value is None else F.map_concat(rest, F.create_map(*[x for n in names for x in (F.lit(n), F.lit(value))]))
