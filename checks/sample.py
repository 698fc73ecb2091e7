"""The driver's tables as inputs of the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.mapping import DRIVER_TABLES, MAPPING, references
from scriptline.operators import chains, orgs, star
from scriptline.operators import medications as med
from scriptline.operators.medicine_filter import Catalogue
from scriptline.plans.model import Model, read_star, write_star
from scriptline.session import new_path, written
from scriptline.sources import catalogues, monthly

AS_OF = "2020-01-01"

_STORED: dict[tuple[str, str, str], DataFrame] = {}
_STARS: dict[tuple[str, str], str] = {}


class Sample:
    """Domain tables as lazy plans (``codes``, ``medications``, ``orgs`` ...), and as an analysis reads them.

    ``catalogue`` and ``model`` hold the dimensions as an ingest leaves them: written once per session to the
    shared folder. Facts are always the line items themselves.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = written(build(), name)
        return _STORED[key]

    def table(self, name: str) -> DataFrame:
        """A driver table or a derived one."""
        if name not in self._tables:
            if name in DRIVER_TABLES:
                found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = MAPPING[name]
                found = self.spark.sql(sql, **{n: self.table(n) for n in references(sql)})
            self._tables[name] = found
        return self._tables[name]

    @property
    def source(self) -> DataFrame:
        return self.table("source")

    @cached_property
    def list_sizes(self) -> DataFrame:
        return monthly.practice_totals(self.table("list_raw"))

    @cached_property
    def codes(self) -> DataFrame:
        return catalogues.load_bnf_codes(self.table("bnf_wide"))

    @cached_property
    def medications(self) -> DataFrame:
        t = self.table
        return med.medications(t("vmp"), t("amp"), t("code_map"), t("ont"), t("form_route"), t("vpi"))

    @cached_property
    def prescribed(self) -> DataFrame:
        presentations = self.stored("presentations", lambda: star.presentations(self.source))
        return med.medications_prescribed(self.catalogue.medications, med.presentations_recent(presentations, "2001-09-01"))

    @cached_property
    def catalogue(self) -> Catalogue:
        codes = self.stored("codes", lambda: self.codes)
        meds = self.stored("medications", lambda: self.medications)
        return Catalogue(codes, meds, self.table("form_route"), self.table("ing"), self.table("vtm"))

    @cached_property
    def ods(self) -> DataFrame:
        """Organisation records in their nested form. A network has at most four partner relations here."""
        rel = self.table("partner_rel").select(
            F.col("pcn").alias("id"),
            F.struct(
                F.col("source").alias("sourceOrgCode"),
                F.lit(orgs.PARTNER_RELATION).alias("relationshipTypeCode"),
                F.col("op_start").alias("opStartDate"),
                F.col("op_end").alias("opEndDate"),
            ).alias("rel"),
        )
        nested = rel.groupBy("id").agg(F.create_map(F.lit(orgs.COST_CENTRE_ROLE), F.collect_list("rel")).alias("relationships"))
        return (
            self.table("ods")
            .join(nested, "id", "left")
            .select(
                "id",
                "name",
                "inactive",
                F.col("primary_role").alias("primaryRole"),
                F.col("primary_name").alias("primaryRoleName"),
                F.array("role").alias("roleName"),
                F.array_compact(F.array("partner1", "partner2")).alias("isPartnerToCode"),
                F.col("re4").alias("RE4"),
                F.col("icb").alias("ICB"),
                F.col("nhser").alias("NHSER"),
                "country",
                "relationships",
            )
        )

    @cached_property
    def orgs(self) -> DataFrame:
        return orgs.org_classify(self.ods)

    @cached_property
    def org_edges(self) -> DataFrame:
        return orgs.org_parents(self.ods, AS_OF)

    @property
    def stored_orgs(self) -> DataFrame:
        return self.stored("orgs", lambda: self.orgs)

    @property
    def stored_members(self) -> DataFrame:
        return self.stored("members", lambda: orgs.org_practices(self.orgs, self.org_edges))

    @cached_property
    def model(self) -> Model:
        """Facts keyed by part; medicines under their current code."""
        facts = self.table("facts")
        practices = self.stored("practices", lambda: star.latest_by_practice(facts))
        presentation = self.stored("presentation", self._current_codes)
        return Model(
            facts.where(F.col("practice_code") != star.NO_PRACTICE),
            presentation,
            self.stored("list_sizes", lambda: self._known_list_sizes(practices)),
            self.stored("dates", lambda: facts.select("date").distinct()),
            practices,
            self.stored_orgs,
            self.stored_members,
            self.catalogue,
            presentation_rows=presentation.count(),
            practice_rows=practices.count(),
            org_rows=self.stored_orgs.count(),
        )

    def _current_codes(self) -> DataFrame:
        changes = self.table("bnf_changes")
        codes = self.table("part_code").join(changes, F.col("bnf_code") == F.col("old_code"), "left")
        return codes.select(F.col("p_partkey").alias("id"), F.coalesce("new_code", "bnf_code").alias("bnf_code"))

    def _known_list_sizes(self, practices: DataFrame) -> DataFrame:
        return self.list_sizes.join(practices.select(F.col("code").alias("practice_code")), "practice_code", "left_semi")


def build_star(sample: Sample) -> str:
    """Write the star of the sample's source; returns its path."""
    path = new_path(sample.spark, "star")
    changes = chains.vmp_code_change_chain(sample.table("vmp"))
    write_star(sample.source, sample.list_sizes, sample.table("bnf_changes"), changes, path)
    return path


def star_model(sample: Sample) -> Model:
    """The sample's model on a star that is written once per session."""
    key = (sample.spark.sparkContext.applicationId, sample.sf_dir)
    if key not in _STARS:
        _STARS[key] = build_star(sample)
    return read_star(sample.spark, _STARS[key], sample.stored_orgs, sample.stored_members, sample.catalogue)
