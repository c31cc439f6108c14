"""What a reader sees: labels made from facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of modalities and statuses.
MODALITY_LABELS = {
    "SMALL_MOLECULE": "Small molecule",
    "PEPTIDE": "Peptide",
    "OLIGONUCLEOTIDE": "Oligonucleotide",
    "MONOCLONAL_ANTIBODY": "Monoclonal antibody",
    "CELL_THERAPY": "Cell therapy",
    "GENE_THERAPY": "Gene therapy",
    "VACCINE": "Vaccine",
    "OTHER": "Other / complex molecule",
    "UNCLASSIFIED": "Unclassified",
}
STATUS_LABELS = {"ELIGIBLE": "Eligible", "DEFERRED": "Deferred", "NON_FORFEITURE": "Non-forfeiture", "EXTINGUISHED": "Extinguished"}


def label(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[value], value)


def submission_label(kind: Column, date: Column) -> Column:
    day = F.date_format(date, "MMM d, yyyy")
    return F.when(kind == "PRE_MMA", "Pre-MMA").when((kind == "RECEIVED_PRIOR_TO") & date.isNotNull(), F.concat(F.lit("Before "), day)).when(date.isNotNull(), day).otherwise("Unknown")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def percent(done: Column, total: Column) -> Column:
    """Whole percent; 0 of nothing."""
    return F.when(total == 0, 0).otherwise(F.round(done * 100 / total)).cast("int")


def envelope(data: Column, total: Column, limit: int, offset: int) -> Column:
    """A page as JSON: the rows, the true total and whether there is more."""
    page = F.struct(total.alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset) + F.size(data) < total).alias("hasMore"))
    return F.to_json(F.struct(data.alias("data"), page.alias("pagination")))
