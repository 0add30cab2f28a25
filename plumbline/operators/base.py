"""The normalised review view that the analytics read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import timestamps
from plumbline.operators.reviews import current_reviews

COLUMNS = (
    "place_id place_name place_category reviewer_id reviewer_name rating text published_at city region country"
    " latitude longitude source source_url"
).split()


def iso_day(published_at: Column) -> Column:
    """The strict ISO date in the first ten characters, else null."""
    head = F.substring(published_at, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def review_view(reviews: DataFrame, columns: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Current reviews; ask only for the columns you need: the rest stays in the files.

    ``day`` is the UTC day of the instant that ``published_at`` names (see ``timestamps.with_instants``), and
    ``published_at`` the instant's canonical form, as written where it names none. Both need the timestamps to be
    read, so ask for them only where they are used.
    """
    wanted = list(columns or [*COLUMNS, "day"])
    plain = [c for c in wanted if c != "day"]
    dated = {"day", "published_at"} & set(wanted)
    # the same columns decide between deliveries of one version, whatever is asked for
    current = current_reviews(reviews, list(dict.fromkeys(["rating", "source_url", *plain, *(("published_at", "source") if dated else ())])))
    if dated:
        current = timestamps.with_instants(current, sources, zones=timestamps.written_zones(reviews))
        current = current.withColumn("published_at", F.coalesce(timestamps.utc_text(F.col("instant_us")), F.col("published_at"))).withColumnRenamed("utc_day", "day")
    return current.select("review_id", *wanted)
