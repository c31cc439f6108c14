"""Transparent rules that sort product names into modalities and classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of salts, esters and hydrates that are no part of an active ingredient's name.
SALTS = [
    "sodium", "potassium", "calcium", "magnesium", "zinc", "lithium", "aluminum", "ammonium", "disodium", "dipotassium", "hydrochloride", "hcl",
    "hydrobromide", "hbr", "hydriodide", "bromide", "chloride", "iodide", "besylate", "besilate", "mesylate", "mesilate", "tosylate", "tosilate",
    "esylate", "edisylate", "edisilate", "camsylate", "camsilate", "napsylate", "napsilate", "maleate", "fumarate", "succinate", "tartrate",
    "citrate", "acetate", "sulfate", "sulphate", "phosphate", "nitrate", "gluconate", "lactate", "malate", "oxalate", "benzoate", "palmitate",
    "stearate", "valerate", "propionate", "dipropionate", "diproprionate", "decanoate", "enanthate", "cypionate", "pivalate", "furoate", "pamoate",
    "embonate", "edetate", "xinafoate", "trometamol", "tromethamine", "meglumine", "lysine", "arginine", "monohydrate", "dihydrate", "trihydrate",
    "hemihydrate", "anhydrous",
]

# Name endings and their modality; the longest that any word has decides.
STEMS = {
    "mab": "MONOCLONAL_ANTIBODY",
    "tug": "MONOCLONAL_ANTIBODY",
    "bart": "MONOCLONAL_ANTIBODY",
    "ment": "MONOCLONAL_ANTIBODY",
    "mig": "MONOCLONAL_ANTIBODY",
    "cel": "CELL_THERAPY",
    "cabtagene": "CELL_THERAPY",
    "gene": "GENE_THERAPY",
    "repvec": "GENE_THERAPY",
    "vec": "GENE_THERAPY",
    "bac": "GENE_THERAPY",
    "plasmid": "GENE_THERAPY",
    "rsen": "OLIGONUCLEOTIDE",
    "siran": "OLIGONUCLEOTIDE",
    "tide": "PEPTIDE",
    "relin": "PEPTIDE",
    "pressin": "PEPTIDE",
    "parin": "OTHER",
}

# Whole words and their modality, where no ending fits; the first that occurs decides.
KEYWORDS = {
    "vaccine": "VACCINE",
    "antihemophilic": "OTHER",
    "coagulation": "OTHER",
    "immunoglobulin": "OTHER",
    "immunoglobulins": "OTHER",
    "globulin": "OTHER",
    "allergen": "OTHER",
    "allergens": "OTHER",
    "allergenic": "OTHER",
    "antivenin": "OTHER",
    "antitoxin": "OTHER",
}

# Classes by ending (with words that only look like it), then by whole words; the first decides.
CLASS_STEMS = [
    ("Statin", "statin", ["cilastatin", "nystatin", "pentostatin"]),
    ("Angiotensin receptor blocker (ARB)", "sartan", []),
    ("ACE inhibitor", "pril", []),
    ("Beta blocker", "olol", []),
    ("Kinase inhibitor", "tinib", []),
    ("CDK4/6 inhibitor", "ciclib", []),
    ("SGLT2 inhibitor", "gliflozin", []),
    ("DPP-4 inhibitor", "gliptin", []),
    ("Penicillin-class antibiotic", "cillin", []),
]
CLASS_KEYWORDS = [
    ("Clotting factor", ["antihemophilic", "coagulation"]),
    ("Immunoglobulin", ["immunoglobulin", "immunoglobulins", "globulin"]),
    ("Allergenic extract", ["allergen", "allergens", "allergenic"]),
    ("Antivenom / antitoxin", ["antivenin", "antitoxin"]),
]

MODALITIES = ["SMALL_MOLECULE", "PEPTIDE", "OLIGONUCLEOTIDE", "MONOCLONAL_ANTIBODY", "CELL_THERAPY", "GENE_THERAPY", "VACCINE", "OTHER", "UNCLASSIFIED"]


def tokens(name: Column) -> Column:
    """Lower-case words of letters only, without words of salts."""
    raw = F.split(F.lower(name), r"(?U)[\s;,()/]+")
    letters = F.transform(raw, lambda t: F.regexp_replace(t, "[^a-z]", ""))
    return F.filter(letters, lambda t: (t != "") & ~t.isin(SALTS))


def modality(name: Column, fallback: Column | str, stems: dict[str, str] | None = None, keywords: dict[str, str] | None = None) -> Column:
    """The modality of the longest ending that any word has, else of the first keyword, else the fallback.

    Of endings of one length the one on the earlier word decides; for a name that is null, the fallback.
    """
    stems, keywords = stems or STEMS, keywords or KEYWORDS
    words = F.coalesce(tokens(name), F.array().cast("array<string>"))
    table = F.array(*[F.struct(F.lit(len(s)).alias("n"), F.lit(s).alias("stem"), F.lit(m).alias("modality")) for s, m in stems.items()])

    def longest(word: Column) -> Column:
        fits = F.filter(table, lambda r: word.endswith(r["stem"]))
        return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["modality"].alias("modality"))))

    found = F.filter(F.transform(words, lambda w, i: F.struct(longest(w)["n"].alias("n"), (-i).alias("i"), longest(w)["modality"].alias("modality"))), lambda r: r["n"].isNotNull())
    by_word = F.coalesce(*[F.when(F.array_contains(words, k), F.lit(m)) for k, m in keywords.items()])
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.array_max(found)["modality"], by_word, other)


def _ending(stem: str, but: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.endswith(stem) & ~w.isin(but) if but else w.endswith(stem)


def drug_class(name: Column) -> Column:
    """The first class that a word's ending or a whole word gives, or null."""
    words = F.coalesce(tokens(name), F.array().cast("array<string>"))
    by_stem = [F.when(F.exists(words, _ending(stem, but)), F.lit(label)) for label, stem, but in CLASS_STEMS]
    by_word = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), F.lit(label)) for label, keys in CLASS_KEYWORDS]
    return F.coalesce(*by_stem, *by_word)

