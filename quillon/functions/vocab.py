"""The two closed vocabularies: what has become of a text, and how much weight it has. No defaults."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import ValidityError

from .textexpr import strip, text


class Validity(str, Enum):
    IN_FORCE = "in-force"
    AMENDED = "amended"
    STRUCK_DOWN = "struck-down"
    READ_DOWN = "read-down"
    NOT_YET_APPLICABLE = "not-yet-applicable"
    REPEALED = "repealed"

    def banner(self, note: str = "") -> str:
        shown = BANNERS[self.value]
        return shown.removesuffix("]") + f" — {note}]" if note else shown


class AuthorityTier(str, Enum):
    CONSTITUTIONAL = "constitutional"
    LEGISLATIVE = "legislative"
    DELEGATED = "delegated"
    JUDICIAL = "judicial"
    REGULATORY_GUIDANCE = "regulatory-guidance"
    COMMENTARY = "commentary"

    @property
    def rank(self) -> int:
        return TIERS.index(self.value)


VALIDITIES = tuple(v.value for v in Validity)
TIERS = tuple(t.value for t in AuthorityTier)
_NOT_LAW = "this text is NOT current law"
BANNERS = dict(
    zip(
        VALIDITIES,
        (
            "[in force]",
            "[AMENDED since enactment: quote the consolidated version, not this one]",
            f"[STRUCK DOWN: {_NOT_LAW}]",
            "[READ DOWN by a court: the text as written overstates what it now means]",
            "[NOT YET APPLICABLE: enacted but not yet in application]",
            f"[REPEALED: {_NOT_LAW}]",
        ),
    )
)


def _member(of: type[Enum], raw, name: str):
    if isinstance(raw, of):
        return raw
    token = "" if raw is None else str(raw).strip().lower()
    legal = ", ".join(m.value for m in of)
    if not token:
        raise ValidityError(f"{name} is empty and has no default; state one of: {legal}.")
    try:
        return of(token)
    except ValueError:
        raise ValidityError(f"{name} '{token[:60]}' is unknown; the vocabulary is: {legal}.") from None


def parse_validity(raw) -> Validity:
    return _member(Validity, raw, "validity")


def parse_authority_tier(raw) -> AuthorityTier:
    return _member(AuthorityTier, raw, "authority_tier")


def quotable_as_current_law(validity) -> bool:
    return parse_validity(validity) is Validity.IN_FORCE


def token(c: Column) -> Column:
    return F.lower(strip(text(c)))


def member(c: Column, legal: tuple[str, ...]) -> Column:
    """The token in its normal form; null where the vocabulary hasn't it."""
    return F.when(token(c).isin(*legal), token(c))


def quotable(validity: Column) -> Column:
    return token(validity) == Validity.IN_FORCE.value


def rank(tier: Column) -> Column:
    """0 for the most authoritative tier; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(0).cast("long")).cast("int") - 1


def banner(validity: Column, note: Column) -> Column:
    shown = F.coalesce(*[F.when(validity == v, F.lit(b)) for v, b in BANNERS.items()])
    return F.when(text(note) == "", shown).otherwise(F.concat(F.substring(shown, F.lit(1), F.length(shown) - 1), F.lit(" — "), note, F.lit("]")))
