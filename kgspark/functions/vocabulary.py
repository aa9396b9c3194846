"""Phrase lists, stop lists, types and priorities of the data model."""

TRANSITIONS = (
    "however",
    "for example",
    "in contrast",
    "therefore",
    "this means",
    "on the other hand",
    "furthermore",
    "moreover",
    "nevertheless",
    "consequently",
    "in addition",
    "similarly",
    "alternatively",
    "specifically",
    "for instance",
)

DEFINITION_PHRASES = ("is defined as", "refers to", "is called", "means that", "can be defined as", "is known as", "we define", "definition:")
EXAMPLE_PHRASES = ("for example", "for instance", "consider", "let's say", "suppose", "imagine that", "e.g.", "such as")

STOP_CONCEPTS = (
    "model", "data", "system", "learning", "process", "method", "approach", "technique", "algorithm", "problem", "solution",
    "value", "result", "output", "input", "parameter", "function", "variable", "training", "testing", "validation", "performance",
    "accuracy", "error", "loss", "feature", "sample", "dataset", "example", "task", "goal", "objective",
)

ERROR_TITLES = ("404", "not found", "access denied", "forbidden", "just a moment", "attention required", "error", "captcha", "blocked")
ERROR_CONTENTS = ("page not found", "access denied", "forbidden", "just a moment", "attention required", "verify you are human", "captcha", "request blocked", "error 404")

TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source")

IGNORED_TAGS = ("nav", "footer", "header", "aside", "script", "style", "noscript")
IGNORED_CLASSES = ("ad", "advertisement", "social", "share", "comment")

#: Relation types and the priority that decides conflicts; others have 0.
RELATION_PRIORITY = {
    "DEFINES": 5,
    "CAUSES": 4,
    "DEPENDS_ON": 3,
    "PART_OF": 3,
    "USES": 2,
    "EXTENDS": 2,
    "CONTRASTS_WITH": 2,
    "MEASURED_BY": 2,
    "ASSOCIATED_WITH": 1,
}
DEPENDENCY_RELATIONS = ("DEPENDS_ON", "REQUIRES", "PART_OF")
STRONG_RELATIONS = ("CAUSES", "DEFINES", "PART_OF")

INTENTS = ("ask_question", "explain_concept", "view_graph", "quality_check", "prerequisites", "summarize", "fact_check", "suggest", "navigate", "unknown")
