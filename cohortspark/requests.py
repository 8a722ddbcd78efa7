"""Requests, normalised: aliases merged and weights checked before a job is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Weights:
    """Weights of a similarity search; at least one is above 0."""

    symptoms: float = 0.4
    diagnosis: float = 0.4
    demographic: float = 0.1
    visit: float = 0.1

    def __post_init__(self) -> None:
        values = (self.symptoms, self.diagnosis, self.demographic, self.visit)
        if min(values) < 0:
            raise ValueError("weights must not be negative")
        if sum(values) <= 0:
            raise ValueError("at least one weight must be above 0")

    def as_dict(self) -> dict[str, float]:
        return {"symptoms": self.symptoms, "diagnosis": self.diagnosis, "demographic": self.demographic, "visit": self.visit}


@dataclass(frozen=True)
class MatchWeights:
    """Weights of ontology and vector likeness, and the cut below which a case is no match."""

    w_lca: float = 0.5
    w_vector: float = 0.5
    min_similarity: float = 0.5

    def __post_init__(self) -> None:
        if self.w_lca < 0 or self.w_vector < 0 or not 0 <= self.min_similarity <= 1:
            raise ValueError("weights must not be negative and the cut must lie in 0..1")


ENTITY_TYPES = {"chiefcomplaint": "symptom", "chiefcomplain": "symptom", "symptom": "symptom", "diagnosis": "diagnosis"}


@dataclass(frozen=True)
class RankRequest:
    """Molecules by their use in similar cases, for one entity."""

    entity_type: str
    query: str
    k: int = 5
    age: float | None = None
    gender: str | None = None
    weights: MatchWeights = field(default_factory=MatchWeights)
    top_cases: int = 20
    pool: int = 500


def _between(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}")
    return value


def rank_request(given: dict) -> RankRequest:
    """A ranking request from a JSON object: aliases of type, weights, age and gender merged, limits checked.

    An explicit patient_age comes before age, and both before patient_info;
    params stand for weights where none are given.
    """
    kind = ENTITY_TYPES.get(str(given.get("type", "")).strip().lower())
    query = str(given.get("query") or "").strip()
    if kind is None or not query:
        raise ValueError("type must be a symptom or diagnosis, and query must not be blank")
    info = given.get("patient_info") or {}
    first = lambda *values: next((v for v in values if v is not None), None)
    weights = {k: v for k, v in (given.get("weights") or given.get("params") or {}).items() if k in ("w_lca", "w_vector", "min_similarity") and v is not None}
    age = first(given.get("patient_age"), given.get("age"), info.get("age"))
    return RankRequest(
        kind,
        query,
        _between("k", int(given.get("k", 5)), 1, 50),
        None if age is None else float(age),
        first(given.get("patient_gender"), given.get("gender"), info.get("gender")),
        replace(MatchWeights(), **weights),
        _between("top_cases_limit", int(given.get("top_cases_limit", 20)), 1, 100),
        _between("candidate_pool_limit", int(given.get("candidate_pool_limit", 500)), 10, 2000),
    )


def case_request(given: dict) -> dict:
    """A case from a JSON object: symptom stands for symptoms, top_k for top_k_per_entity, single texts for lists; blanks are dropped."""
    case = given.get("case") or given

    def listed(*names: str) -> list[str]:
        value = next((case[n] for n in names if case.get(n)), [])
        return [x.strip() for x in ([value] if isinstance(value, str) else value) if x and x.strip()]

    info = case.get("patientInfo") or {}
    top_k = given.get("top_k") if given.get("top_k") is not None else given.get("top_k_per_entity", 5)
    return {
        "case_no": case.get("caseNo"),
        "case_date": case.get("caseDate"),
        "visit_type": case.get("visitType"),
        "age": info.get("age"),
        "gender": info.get("gender"),
        "symptoms": listed("symptoms", "symptom"),
        "diagnoses": listed("diagnosis", "diagnoses"),
        "top_k": _between("top_k", int(top_k), 1, 20),
    }
