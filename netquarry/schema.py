"""Node types, relations and weights of the property graph.

All dictionaries and sets here are fixed values of the data model.
"""

from __future__ import annotations

NODE_TYPES = ("Module", "Port", "Register", "Clock", "Parameter", "Instance", "Net", "Constraint", "Assertion", "Test", "Commit")

DEFAULT_WEIGHT = 0.5
# The relations along which impact spreads, with their weights
WEIGHTS = {
    "instantiates": 1.0, "depended_by": 0.8, "has_port": 1.0, "has_instance": 1.0, "contains_register": 1.0,
    "clocked_by": 0.8, "constrained_by": 0.7, "applies_to": 0.7, "references_clock": 0.6, "derived_from": 0.8,
    "verifies": 0.7, "verified_by": 0.7, "covers": 0.6, "modifies": 1.0, "modified_by": 1.0,
    "drives": 0.9, "instance_of": 0.9, "has_parameter": 0.8, "parameter_of": 0.8, "uses_clock": 0.7,
}
PROPAGATION = tuple(WEIGHTS)

# Weights that replace the above for a type of change
OVERRIDES = {
    "clock": {"clocked_by": 1.0, "constrained_by": 0.9, "derived_from": 1.0},
    "width": {"drives": 1.0, "has_port": 1.0, "connected_to": 1.0},
    "parameter": {"has_parameter": 1.0, "parameter_of": 1.0, "drives": 0.7},
}

# Relations along which the truth about a change spreads, by its type
TRUTH_DEPTH = 6
_STRUCTURE = ("depended_by", "instantiates", "has_port", "has_instance", "constrained_by", "verified_by", "covers", "contains_register", "clocked_by")
TRUTH_RELATIONS = {
    "parameter": ("depended_by", "has_parameter", "has_port", "constrained_by", "verified_by", "covers"),
    "width": ("depended_by", "has_port", "drives", "constrained_by", "verified_by", "covers", "instantiates", "has_instance"),
    "clock": ("depended_by", "contains_register", "clocked_by", "constrained_by", "applies_to", "derived_from", "verified_by", "covers", "has_port"),
    "reset": ("depended_by", "contains_register", "has_port", "verified_by", "covers"),
    "dependency": _STRUCTURE,
    "hierarchy": _STRUCTURE,
    "constraint": ("applies_to", "references_clock", "constrained_by"),
}
TRUTH_FALLBACK = (
    "depended_by", "instantiates", "has_port", "has_instance", "contains_register", "has_parameter", "constrained_by", "drives",
    "clocked_by", "applies_to", "derived_from", "references_clock", "verified_by", "verifies", "covers",
)
