"""A facade over one collection of notes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators import history, links
from quillstack.operators.index import Index, build_index
from quillstack.plans.search import search
from quillstack.schema import empty_note


class Library:
    """Holds DataFrames; every verb that changes something returns a new library."""

    def __init__(self, notes: DataFrame, versions: DataFrame | None = None):
        self.notes, self.versions = notes, versions

    @cached_property
    def index(self) -> Index:
        return build_index(self.notes)

    @cached_property
    def graph(self) -> DataFrame:
        return links.edges(self.notes)

    @cached_property
    def tags(self) -> DataFrame:
        return links.tag_tree(self.notes)

    @property
    def counts(self) -> DataFrame:
        return links.library_counts(self.notes)

    def search(self, queries: list[tuple[str, str]] | DataFrame, now: int, **options) -> DataFrame:
        return search(self.index, self.notes, queries, now, **options)

    def listing(self, key: str = "updated", ascending: bool = False) -> DataFrame:
        return links.sort_notes(self.notes.where("trashed_at is null and not archived"), key, ascending)

    def create(self, note_id: str, now: int, **fields) -> Library:
        row = self.notes.sparkSession.createDataFrame([{**empty_note(note_id, now), **fields}], self.notes.schema)
        return Library(self.notes.unionByName(history.with_derived(row).select(self.notes.columns)), self.versions)

    def update(self, edits: DataFrame, now: int) -> Library:
        return Library(history.apply_edits(self.notes, edits, now), self.versions)

    def trash(self, ids: DataFrame, now: int) -> Library:
        return Library(history.trash(self.notes, ids, now), self.versions)

    def restore(self, ids: DataFrame, now: int) -> Library:
        return Library(history.trash(self.notes, ids, now, restore=True), self.versions)

    def destroy(self, ids: DataFrame) -> Library:
        return Library(history.destroy(self.notes, ids), None if self.versions is None else history.destroy(self.versions, ids))

    def empty_trash(self) -> Library:
        gone = self.notes.where(F.col("trashed_at").isNotNull())
        return self.destroy(gone)

    def resolve_link(self, title: str) -> DataFrame:
        return links.resolve(self.notes, title)

    def backlinks(self, note_id: str) -> DataFrame:
        return links.backlinks(self.notes, note_id)

    def title_suggestions(self, queries: list[tuple[str, str]], most: int = 8) -> DataFrame:
        return links.title_suggestions(self.notes, queries, most)
