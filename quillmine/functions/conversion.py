"""Conversion of characters and phrases by a table, the longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conversion:
    """A table of phrases and characters and what each becomes.

    At every place the longest entry that starts there is taken, so phrases come before characters; what no entry
    starts at stays. Entries are looked up by their first character and then by length, longest first.
    """

    #: Bound of a table, which travels to every task.
    MOST_ENTRIES = 500_000

    def __init__(self, table: Mapping[str, str]):
        if len(table) > self.MOST_ENTRIES:
            raise ValueError(f"a conversion has at most {self.MOST_ENTRIES} entries")
        self.table = {k: v for k, v in table.items() if k}
        lengths: dict[str, set[int]] = {}
        for key in self.table:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(found, reverse=True) for c, found in lengths.items()}

    @classmethod
    def from_lines(cls, lines: Iterable[str], *more: Mapping[str, str]) -> Conversion:
        """From lines of a phrase, a tab, and its forms separated by blanks, of which the first counts; `more` are tables of lower rank."""
        table: dict[str, str] = {}
        for other in reversed(more):
            table |= other
        for line in lines:
            key, _, forms = line.rstrip("\r\n").partition("\t")
            if key and forms.split():
                table[key] = forms.split()[0]
        return cls(table)

    @classmethod
    def from_table(cls, rows: DataFrame) -> Conversion:
        """From rows of phrase and form; of a repeated phrase the smallest form counts."""
        found = rows.where("phrase <> '' and form is not null").groupBy("phrase").agg(F.min("form").alias("form")).limit(cls.MOST_ENTRIES + 1).collect()
        return cls({r.phrase: r.form for r in found})

    def convert(self, text: str) -> str:
        lengths, table = self.lengths, self.table
        if not any(c in lengths for c in set(text)):
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            for size in lengths.get(text[at], ()):
                form = table.get(text[at : at + size])
                if form is not None and at + size <= n:
                    out.append(form)
                    at += size
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def column(self, text: Column) -> Column:
        """The converted text, for whole batches in Python; a null stays null."""
        own = self

        @F.pandas_udf("string")
        def converted(texts: pd.Series) -> pd.Series:
            return texts.map(own.convert, na_action="ignore")

        return converted(text)
