"""Quasi-identifier sets, protection settings and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
DEMO_GEO = ("census_tract", "applicant_age", "applicant_sex", "derived_race", "derived_ethnicity")
FINANCIAL = (*DEMO_GEO, "income", "loan_amount", "loan_type", "debt_to_income_ratio", "loan_purpose", "occupancy_type", "lien_status", "derived_dwelling_category")
INSTITUTION = (*FINANCIAL, "lei")
TIERS = {"demographic_geo": DEMO_GEO, "financial_context": FINANCIAL, "institution_aware": INSTITUTION}
FORBIDDEN = ("uli", "universal_loan_identifier", "property_address", "applicant_name", "nmls_identifier")
SENSITIVE = ("action_taken", "denial_reason_1", "denial_reason_2", "denial_reason_3")
MIN_CELL = 20
WHITE, BLACK, NON_HISPANIC = "White", "Black or African American", "Not Hispanic or Latino"
DECISIONS, DENIALS = (1, 2, 3, 7), (3, 7)
UNIVERSES = ("full_state_year", "full_national_year")


@dataclass(frozen=True)
class QIConfig:
    fields: tuple[str, ...] = INSTITUTION
    forbidden: tuple[str, ...] = FORBIDDEN
    sensitive: tuple[str, ...] = SENSITIVE
    minimum_cell_size: int = MIN_CELL
    k_thresholds: tuple[int, ...] = (1, 5, 10)

    def __post_init__(self):
        if not self.fields:
            raise ValueError("at least one quasi-identifier is needed")
        if overlap := set(self.fields) & set(self.forbidden):
            raise ValueError(f"direct identifiers among the quasi-identifiers: {sorted(overlap)}")


@dataclass(frozen=True)
class ProtectionConfig:
    name: str
    geography: str = "tract"
    income_band: float | None = None
    loan_amount_band: float | None = None
    suppress_k_below: int | None = None
    bands: dict[str, float] = field(init=False, default_factory=dict, compare=False)

    def __post_init__(self):
        if self.geography not in ("tract", "county", "state", "national"):
            raise ValueError(f"unsupported geography: {self.geography}")
        found = {"income": self.income_band, "loan_amount": self.loan_amount_band}
        self.bands.update({k: v for k, v in found.items() if v is not None})
        if any(v <= 0 for v in self.bands.values()):
            raise ValueError("band widths must be positive")
        if self.suppress_k_below is not None and self.suppress_k_below < 2:
            raise ValueError("suppress_k_below must be at least 2")


PROTECTIONS = (
    ProtectionConfig("cfpb_current", suppress_k_below=5),
    ProtectionConfig("county_geo", "county", suppress_k_below=5),
    ProtectionConfig("county_banded", "county", 25_000, 50_000, 5),
    ProtectionConfig("state_banded", "state", 50_000, 100_000, 5),
)
UNSUPPRESSED = ProtectionConfig("cfpb_current_unsuppressed")
