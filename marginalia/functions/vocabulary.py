"""Section vocabulary: phrases, word patterns, markers and label sets."""

from __future__ import annotations

# Everything in this module must be exactly so for the labels to be right.

#: Header phrases (stripped, lower-cased) that settle a label on their own.
PHRASES: dict[str, tuple[str, ...]] = {
    "conclusion": (
        "conclusion", "v. conclusion", "conclusion and recommendations", "iv. conclusion", "conclusions", "summary", "epilogue", "considerations",
        "final considerations", "recommendations", "recommendation", "outlook", "open questions", "perspective", "concluding remarks",
        "final remarks", "future work", "future directions", "further work",
    ),
    "discussion": (
        "discussion", "results and discussion", "discussion and conclusions", "discussion and conclusion", "discussions", "limitations",
        "strengths and limitations", "practical implications",
    ),
    "ending": (
        "acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "supporting information", "supplementary information",
        "supplementary material", "supplementary", "references", "abbreviations",
    ),
    "figure_table": (
        "figure", "table",
    ),
    "introduction": (
        "introduction", "case report", "case presentation", "background", "objective", "objectives", "motivation", "problem", "preliminaries",
        "preamble", "prologue", "overview", "hypothesis", "hypotheses", "problem statement", "problem definition", "problem formulation",
        "research questions", "research question",
    ),
    "lit_review": (
        "background literature", "review of literature", "literature review", "related work", "related works", "similar work", "previous work",
        "previous works", "related research", "similar research", "state of the art", "state-of-the-art", "theory", "theoretical framework",
        "theoretical background", "theoretical foundation",
    ),
    "methods": (
        "methods", "materials and methods", "material and methods", "material and method", "methods and materials", "materials", "methodology",
        "method", "research methodology", "research methods", "data and methods", "procedures", "procedure", "study setup", "study characteristics",
        "study design", "research design", "measures", "treatment", "design", "study area", "variables", "setting", "measurements",
        "evaluation metrics", "ablation study", "patients", "patient characteristics", "subjects", "participants", "samples", "study participants",
        "animals", "demographics", "recruitment", "implementation", "approach", "technical approach", "implementation details", "model architecture",
        "system architecture", "algorithm", "model", "the model", "data", "clinical trial", "clinical trials", "inclusion criteria",
        "exclusion criteria", "inclusion and exclusion criteria", "exclusion and inclusion criteria", "search strategy", "study selection",
        "statistics", "statistical analysis", "statistical analyses", "statistical methods", "experimental design", "experiment", "experiments",
        "experimental setup", "experimental set-up", "experimental procedures", "experimental apparatus", "experimental details",
        "experimental setting", "data analysis", "data collection", "data extraction", "data sources", "data source", "dataset", "datasets",
        "patients and methods", "subjects and methods", "study design and participants", "study population", "sample", "sample collection",
        "sample size", "sample preparation", "sampling", "western blot analysis", "western blotting", "immunohistochemistry", "cell culture", "cells",
    ),
    "other": (
        "author", "authors' contributions", "author contributions", "conflicts of interest", "conflict of interest",
        "declaration of competing interest", "public interest statement", "funding", "data availability", "data availability statement",
        "ethical considerations", "ethical approval", "ethics statement", "consent", "compliance with ethical standards",
    ),
    "results": (
        "results and discussions", "result and discussion", "results", "main results", "result", "experimental results", "findings",
        "simulation results", "observations", "outcomes", "evaluation", "experimental section",
    ),
}

#: Headers that name two roles at once.
ALTERNATIVES: dict[str, tuple[str, ...]] = {
    "results and discussion": ("results and discussion", "results and discussions", "result and discussion"),
    "discussion and conclusion": ("discussion and conclusion", "discussion and conclusions"),
    "introduction and lit review": (
        "introduction and literature review", "introduction and related work", "background and literature review",
        "background and related work", "literature review and introduction", "related work and introduction",
    ),
}

#: Word patterns in the order in which they are tried; matched as whole words anywhere in a header.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("discussion", r"discussions?|implications?|limitations?"),
    ("conclusion", r"conclusions?|further|future (works?|directions?|outlook|research)|summary|next steps|concluding remarks?"),
    ("results", r"results?|findings?|evaluations?|observations?|effects?"),
    ("ending", r"acknowledg(e|ements?)|references|bibliograph(y|ies)|append(ix|ices)|(supplementary|supporting) (materials?|information)"),
    (
        "introduction",
        r"introductions?|case (report|presentation)|preliminar(y|ies)|hypothes(is|es)|research questions?|"
        r"problem (statement|definition|formulation)|(statement|definition|formulation) of the problem",
    ),
    (
        "lit_review",
        r"theoretical (framework|background|foundation)|(related|previous|similar) (works?|research|literature)|"
        r"literature review|state[- ]of[- ]the[- ]art",
    ),
    (
        "other",
        r"disclosures?|author contributions?|contribution statement|conflicts? of interests?|(competing|conflicting) interests?|"
        r"(ethics?|ethical) (statement|approval|considerations)|(funding|sponsorship) (statement|declaration)|"
        r"(data|code) availability(?: (statement))?",
    ),
    (
        "methods",
        r"methods?|methodolog(y|ies)|materials?|procedures?|protocols?|statistical (analysis|analyses|methods?)|"
        r"(study|research|experimental|simulations?|model|computational|experiments?) "
        r"(design|protocols?|characteristics|strategy|selection|setup|set-up|description|site|populations?|participants?|subjects?|patients?|apparatus|details|setting)|"
        r"(patients?|participants?|subjects?) (recruitment|characteristics|demographics|populations?|groups?)|"
        r"data (analysis|analyses|description|collection|measurement|preprocessing|processing|acquisition|extraction|sources?)|datasets?|"
        r"population samples?|samples? (collection|sizes?|preparations?|processing|characteristics)|"
        r"(model|system|implementation|algorithm|technical) (architecture|approach|details?|implementations?|overview)|"
        r"proposed (models?|systems?|implementations?|algorithms?|architectures?|approach(es)?|stratetg(y|ies)|implementations?)|"
        r"(inclusion|exclusion) criteria",
    ),
    ("figure_table", r"figures?|tables?|fig|charts?"),
)

#: A list marker at the start of a header, with the spaces behind it.
LIST_MARKER = r"^((?:[IVXLCDMivxlcdm]+|\d+|[A-Za-z])[.)])\s*"
#: A section number of the top level: digits, perhaps a dot.  Both top-level patterns end at the end of the text.
TOP_NUMBER = r"^\d+\.?"
#: A list marker that is an upper-case Roman numeral of the top level.
TOP_ROMAN = r"^(X|XX|X?(IX|IV|V|V?I{1,3}))\.?\s*"

RELEVANT = ("introduction", "lit_review", "development", "methods", "results", "discussion", "conclusion")
CORE = ("introduction", "lit_review", "methods", "results", "discussion", "conclusion", "ending")
NOT_LENGTH = ("ending", "other", "figure_table")
NOT_ANNOTATED = ("figure_table", "ending", "other")
UNSUPPORTED = ("something_else", "ambiguous", "case_report")
ANNOTATOR = RELEVANT + ("case_report", "something_else", "ambiguous")
#: Papers left out of the human evaluation.
EXCLUDED_PAPERS = (234586248, 86268276)


def word_pattern(inner: str) -> str:
    return rf"\b({inner})\b"
