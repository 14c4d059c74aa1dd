"""Sources (S1-S8) and sinks (K1-K8)."""

from newsloom.sources.readers import (ARTICLE_SCHEMA, read_articles, read_merges, read_pages, read_sequences,
                                      read_table, read_globs, read_dumps, with_row_index)
from newsloom.sources.writers import write_articles, write_sequences, write_table

__all__ = ["ARTICLE_SCHEMA", "read_articles", "read_merges", "read_pages", "read_sequences", "read_table",
           "read_globs", "read_dumps", "with_row_index", "write_articles", "write_sequences", "write_table"]
