"""Verdicts from a table of rules: what a measurement means, how sure that is, and what to keep in mind.

Rules are data. All that apply to a context are worked out in one pass over its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("low", "medium", "high")
VERDICTS = ("clear", "note", "review")


@dataclass(frozen=True)
class Rule:
    """If the SQL condition `when` holds, finding `id` has this verdict; a null condition doesn't hold. Of an id's rules
    the first that holds counts."""

    id: str
    when: str
    verdict: str
    confidence: str
    plain: str
    caveat: str = ""


class RuleTable:
    """Rules by owner. An owner's rules of an id replace those of owners before it; they come back if it is retracted."""

    def __init__(self, owned: tuple[tuple[str, tuple[Rule, ...]], ...] = ()):
        self.owned = owned

    def add(self, owner: str, *rules: Rule) -> RuleTable:
        """With these rules, in place of any that the owner had."""
        for r in rules:
            if r.verdict not in VERDICTS or r.confidence not in CONFIDENCE:
                raise ValueError(f"{r.id}: a verdict of {VERDICTS} and a confidence of {CONFIDENCE}")
        return RuleTable((*self.retract(owner).owned, (owner, rules)))

    def retract(self, owner: str) -> RuleTable:
        return RuleTable(tuple(x for x in self.owned if x[0] != owner))

    def rules(self) -> dict[str, list[Rule]]:
        """The rules that count, by id in the order in which ids came first."""
        out: dict[str, list[Rule]] = {}
        for _, rules in self.owned:
            own: dict[str, list[Rule]] = {}
            for r in rules:
                own.setdefault(r.id, []).append(r)
            out |= own
        return out


def judged(context: DataFrame, keys: list[str], table: RuleTable, weakened: str | None = None) -> DataFrame:
    """(keys, ord, id, verdict, confidence, plain, caveat): a row for each id of which a rule holds.

    weakened names an array column of ids whose evidence is weak: their confidence is a step lower, low at least. Columns
    that the conditions name must be there.
    """
    faded = F.coalesce(F.col(weakened), F.array().cast("array<string>")) if weakened else F.array().cast("array<string>")

    def finding(place: int, rule: Rule):
        lower = CONFIDENCE[max(0, CONFIDENCE.index(rule.confidence) - 1)]
        sure = F.when(F.array_contains(faded, rule.id), lower).otherwise(rule.confidence)
        fields = (F.lit(place).alias("ord"), F.lit(rule.id).alias("id"), F.lit(rule.verdict).alias("verdict"), sure.alias("confidence"), F.lit(rule.plain).alias("plain"), F.lit(rule.caveat).alias("caveat"))
        return F.when(F.expr(rule.when), F.struct(*fields))

    found = [F.coalesce(*(finding(k, r) for r in rules)) for k, rules in enumerate(table.rules().values())]
    if not found:
        raise ValueError("a table without rules")
    return context.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("r")).select(*keys, "r.*")


#: What the measurements of an integrity pass mean, for one who decides whether to look.
INTEGRITY = RuleTable().add(
    "signalspark",
    Rule("source", "reencoded", "note", "high", "encoded anew by a platform", "ask for the original recording"),
    Rule("source", "true", "clear", "medium", "no trace of a platform's encoder"),
    Rule("splices", "strong_splices >= 3", "review", "high", "several strong splice candidates", "cuts of an edited recording look alike"),
    Rule("splices", "strong_splices > 0", "note", "medium", "a splice candidate", "a dropped frame looks alike"),
    Rule("splices", "strong_splices = 0", "clear", "medium", "no splice candidate"),
    Rule("noise", "noise_outliers > 2", "review", "medium", "the noise floor changes", "lighting changes it too"),
    Rule("noise", "noise_outliers <= 2", "clear", "low", "the noise floor is even"),
    Rule("recompress", "double_quant > 0.35", "note", "medium", "compressed twice", "editing or a download does that"),
    Rule("loops", "loops > 0", "review", "high", "footage comes again", "menus and loading screens repeat"),
    Rule("enf", "enf_jumps > 0", "review", "low", "the mains hum jumps", "needs a recording of the room"),
    Rule("tempo", "tempo_score >= 0.6", "review", "medium", "speed likely changed"),
    Rule("tempo", "tempo_score >= 0.3", "note", "low", "speed possibly changed", "a capture card drops frames"),
    Rule("audio", "audio_warnings > 0", "note", "medium", "the sound has warnings"),
    Rule("container", "container_warnings > 0", "note", "medium", "the container has warnings", "tools write odd containers"),
)
