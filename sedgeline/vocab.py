"""Controlled vocabularies.

All tuples below are fixed values: the names that records, reports and hashes use.
"""

NORMALIZATION = "norm-v1"
SUBJECTS = ("math", "physics", "chemistry", "biology", "earth_science")
BEHAVIORS = ("solve", "explain", "hint", "diagnose")
GROUNDED_BEHAVIORS = ("explain", "hint", "diagnose")
GRADE_BAND = "secondary_9_12"
SPLITS = ("train", "validation", "test", "external_eval")
MEMBERSHIPS = ("qa_pilot", "mini_train", "full", "evaluation")
LICENSE_CLASSES = ("permissive", "share_alike", "noncommercial", "custom_restricted", "unknown", "excluded")
EXPORT_PROFILES = ("permissive", "sharealike", "noncommercial", "internal_only", "excluded")
REVIEW_STATUSES = ("approved", "pending_pin", "pending_license", "excluded")
DIFFICULTIES = ("easy", "medium", "hard")
ANSWER_POLICIES = ("reveal_final", "partial_reveal", "withhold_final")
INTERACTION_MODES = ("single_turn", "multi_turn")
ROLES = ("system", "user", "assistant")
MESSAGE_ORDERS = ("user,assistant", "system,user,assistant")
PRINCIPLES = ("active_learning", "manage_cognitive_load", "adapt_to_learner", "stimulate_curiosity", "deepen_metacognition")
MOVE_INTENTS = {
    "focus": ("seek_strategy", "guide_focus"),
    "probe": ("recall_relevant_fact", "seek_explanation", "seek_self_correction", "perturb_problem", "check_understanding"),
    "tell": ("reveal_strategy", "reveal_step", "reveal_answer"),
    "generic": ("encourage", "greet_or_close", "general_inquiry"),
}
ERROR_TYPES = (
    "none", "concept_confusion", "wrong_assumption", "unsupported_claim", "instruction_miss", "premature_conclusion",
    "arithmetic_error", "algebra_error", "ratio_error", "unit_error", "sign_error", "sign_convention_error",
    "coordinate_choice_error", "formula_selection_error", "transcription_error", "causal_reversal", "category_error",
    "scale_error", "conservation_error", "equilibrium_error", "representation_error",
)
ERROR_CLASSES = ("conceptual", "procedural")
ASSURANCE_TIERS = ("standard", "high")
SELECTION_DECISIONS = ("accept", "reject", "pending")
DEDUP_DECISIONS = ("keep", "reject", "adjudicate")
CURATOR_REVIEWS = ("accepted", "rejected", "pending")
MODEL_INDEPENDENCE = ("same-provider-reduced-independence", "cross-provider", "not-applicable")
SUBJECT_METHODS = ("source_metadata", "deterministic_mapping", "ontology_rule", "jev_choice", "adjudicator")
# The class that an error type has without a verifier; the others are decided case by case.
DEFAULT_ERROR_CLASSES = {
    "procedural": ("arithmetic_error", "transcription_error"),
    "conceptual": (
        "concept_confusion", "wrong_assumption", "causal_reversal", "category_error", "conservation_error", "equilibrium_error",
        "formula_selection_error", "sign_convention_error", "coordinate_choice_error",
    ),
}
CELL_TARGET, CELL_MINIMUM = 500, 400
# How a behavior's or a subject's fitness was decided: with a probability, by rule, by choice.
METHOD_PROBABILITY, METHOD_RULE, METHOD_CHOICE = "jev_noul", "deterministic_source", "jev_choice"
