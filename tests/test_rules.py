"""Scenarios of the ladder and the impact assessment; facts that aren't named are false, those in `unknown` absent."""

import pytest

from lexgrove.plans import ladder

ALL = sorted({*ladder._BANS, *ladder._RISKS, *ladder.DEROGATIONS, *ladder.TRANSPARENCY, "annex_i_covered_product", "medical_or_safety_component", "profiling_of_natural_persons"})


def case(true=(), unknown=(), false=(), domain=None, autonomy=None, deployer=None, **want):
    return ({x: x in true for x in {*ALL, *true, *false} if x not in unknown}, domain, autonomy, deployer, want)


P, H, T, M, U = ladder.CATEGORIES
R = "requires_human_review"
CASES = [
    case(risk_category=M, status="not_applicable", confidence=1.0, fria="does_not_apply"),
    case(unknown=ALL, risk_category=U, status=R, confidence=0.5, fria="unknown"),
    case(["social_scoring"], risk_category=U, status=R),
    case(["social_scoring", "social_score_detrimental_treatment"], risk_category=P, status="potentially_applicable", fria="does_not_apply"),
    case(["social_scoring"], false=["social_score_detrimental_treatment"], risk_category=M),
    case(["facial_image_scraping"], risk_category=P),
    case(["subliminal_or_manipulative", "causes_significant_harm"], unknown=["social_scoring"], risk_category=P, confidence=1.0),
    case(["predictive_policing_profiling", "supports_human_assessment_on_verifiable_facts"], risk_category=M),
    case([ladder.REMOTE, ladder.POLICE], risk_category=H, status=R, annex_iii_category="eu-ai-act:annex-iii:point-1"),
    case([ladder.REMOTE, ladder.POLICE], false=[ladder.REMOTE_LIFT], risk_category=P),
    case([ladder.REMOTE, ladder.POLICE, ladder.REMOTE_LIFT], risk_category=H, status="potentially_applicable"),
    case([ladder.REMOTE], unknown=[ladder.POLICE], risk_category=H, status=R),
    case(["employment_decisions"], risk_category=H, status="potentially_applicable", annex_iii_category="eu-ai-act:annex-iii:point-4", fria="unknown"),
    case(["employment_decisions"], deployer={"body_governed_by_public_law": False, "private_entity_providing_public_services": False}, risk_category=H, fria="does_not_apply"),
    case(["employment_decisions"], deployer={"body_governed_by_public_law": True}, risk_category=H, fria="applies"),
    case(["employment_decisions"], unknown=["facial_image_scraping"], deployer={"body_governed_by_public_law": True}, risk_category=H, status=R, fria="unknown"),
    case(["creditworthiness_evaluation"], risk_category=H, annex_iii_category="eu-ai-act:annex-iii:point-5", fria="applies"),
    case(["critical_infrastructure_safety"], deployer={"body_governed_by_public_law": True}, risk_category=H, fria="does_not_apply"),
    case(["critical_infrastructure_safety"], unknown=["creditworthiness_evaluation"], risk_category=H, fria="unknown"),
    case(["critical_infrastructure_safety", "justice_democratic_use"], deployer={"body_governed_by_public_law": True}, risk_category=H, annex_iii_category="eu-ai-act:annex-iii:point-2", fria="applies"),
    case(domain="employment", risk_category=M),
    case(domain=" Employment​", unknown=["employment_decisions"], risk_category=H, annex_iii_category="eu-ai-act:annex-iii:point-4"),
    case(["employment_decisions", ladder.DEROGATIONS[0]], autonomy="advisory", risk_category=H, status=R, article_6_3_exception_candidate=True, fria="unknown"),
    case(["employment_decisions", ladder.DEROGATIONS[0]], autonomy="automated", risk_category=H, article_6_3_exception_candidate=False),
    case(["employment_decisions", ladder.DEROGATIONS[1], "profiling_of_natural_persons"], risk_category=H, status="potentially_applicable", article_6_3_exception_candidate=False),
    case(["annex_i_covered_product", "third_party_conformity_assessment_required"], risk_category=H, annex_iii_category=None, status="potentially_applicable", fria="does_not_apply"),
    case(["annex_i_covered_product"], risk_category=U, status=R),
    case(["annex_i_covered_product"], false=["third_party_conformity_assessment_required"], risk_category=M),
    case(["medical_or_safety_component"], unknown=["annex_i_covered_product"], risk_category=U),
    case(["interacts_with_natural_persons"], risk_category=T, status="potentially_applicable", fria="does_not_apply"),
    case(["interacts_with_natural_persons"], unknown=["education_scoring_or_access"], risk_category=T, status=R, confidence=0.5),
    case(["emotion_recognition"], risk_category=H, annex_iii_category="eu-ai-act:annex-iii:point-1"),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(i, f, d, a, p) for i, (f, d, a, p, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, (len(CASES), None, None, None, None)], "i int, flags map<string,boolean>, domain string, autonomy string, deployer map<string,boolean>")
    return {x["i"]: x for x in ladder.classify(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(answers, i):
    want = CASES[i][-1]
    assert {k: answers[i][k] for k in want} == want


def test_null_facts_are_unknown(answers):
    assert (answers[len(CASES)]["risk_category"], answers[len(CASES)]["status"]) == (U, R)


def test_citations_and_missing_facts(answers):
    assert answers[3]["cited"] == ["eu-ai-act:article-5:paragraph-1:point-c"]
    assert answers[2]["missing"] == ["flags.social_score_detrimental_treatment"]
    assert answers[12]["cited"] == ["eu-ai-act:annex-iii:point-4", "eu-ai-act:article-6:paragraph-2"]
    assert answers[29]["cited"] == ["eu-ai-act:article-50:paragraph-1"]
