"""Fixed taxonomy of words that occur in the documents table."""

DOCUMENT_WORDS = {
    "english": ["the", "and", "of", "with"],
    "french": ["le", "la", "des", "avec"],
    "german": ["nicht", "und", "der", "sch"],
    "spanish": ["el", "los", "para", "con"],
}
