"""Fixed values that must equal the reference for equal results."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Period labels of the corpus (epoch name -> class id).
EPOCH_LABELS = {
    "Ruthenian": 3,
    "New Church Slavonic": 2,
    "Old Church Slavonic": 1,
    "Church Slavonic": 0,
}
# The 32 ASCII punctuation marks (Python string.punctuation), in order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Function-word list of the corpus language: empty in the reference.
FUNCTION_WORDS: list[str] = []
# Empty tag label and n-gram joiner of the tag analyzers.
UNKNOWN_TAG = "Unk"
NGRAM_JOINER = "-"
# ------------------------------------------------------------------------------

# Stand-in period labels for the driver's `documents` table, whose `lang`
# column plays the role of the epoch (four classes).
LANG_LABELS = {"de": 0, "en": 1, "es": 2, "fr": 3}
