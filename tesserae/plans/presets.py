"""Declared example policies. Nothing here is a default of the engine: callers name the preset they want."""

from __future__ import annotations

from tesserae.operators import invariants
from tesserae.operators.governance import ApprovedException, CalibrationProfile, GovernancePolicy, LayerPolicy, Subsystem, Subsystems, WeightedDimension

# Which role may use which.
MATRIX = {
    "PRESENTATION": ("PRESENTATION", "APPLICATION"),
    "APPLICATION": ("APPLICATION", "DOMAIN", "PERSISTENCE"),
    "DOMAIN": ("DOMAIN", "PERSISTENCE"),
    "PERSISTENCE": ("PERSISTENCE",),
}
STRICT = MATRIX | {"APPLICATION": ("APPLICATION", "DOMAIN")}
THIRDS = CalibrationProfile((WeightedDimension("layer", 1 / 3), WeightedDimension("cycle", 1 / 3), WeightedDimension("persistence", 1 / 3), WeightedDimension("security", 0.0)))


def layered(strict_prefix: str | None = None, strict_name: str = "strict", exceptions: tuple[ApprovedException, ...] = (), budget: float = 0.35) -> GovernancePolicy:
    """Four layers; nodes under strict_prefix may not reach persistence from the application layer."""
    subs = Subsystems((Subsystem(strict_name, strict_prefix, LayerPolicy(tuple(STRICT), STRICT)),)) if strict_prefix else Subsystems()
    rules = (invariants.no_presentation_to_persistence(), invariants.entropy_budget(budget))
    return GovernancePolicy(LayerPolicy(tuple(MATRIX), MATRIX), subs, False, THIRDS, rules, (("no_presentation_to_persistence", 4.0), ("entropy_budget", 1.0)), None, (), exceptions)


def drifting() -> GovernancePolicy:
    """layered() with drift weights, so that risk is defined against a baseline."""
    p = layered()
    return GovernancePolicy(p.layer_policy, p.subsystems, p.include_self_cycles, p.calibration, p.invariants, p.invariant_weights, 2.0, (("layer", 1.0), ("cycle", 0.5), ("persistence", 1.0)), ())


def illustrative(budget: float = 0.35) -> GovernancePolicy:
    """Five roles, each of which may use itself and the next one."""
    order = ("PRESENTATION", "APPLICATION", "DOMAIN", "PERSISTENCE", "INFRASTRUCTURE")
    matrix = {r: order[i : i + 2] for i, r in enumerate(order)}
    return GovernancePolicy(LayerPolicy(order, matrix), Subsystems(), False, THIRDS, (invariants.no_presentation_to_persistence(), invariants.entropy_budget(budget)), (), None, (), ())
