"""Training-data operators: packing, quality, extraction, rules, token files, decontamination,
licences, language-model scores, token counts and near-duplicates.

Nothing else in the library imports this package.  Conventions shared by all operators:

* input tables are read by column name, so extra columns (also with clashing names) are ignored;
* a null text is an empty text; an empty table gives an empty result;
* ``doc_id`` identifies a document: repeated rows are each returned;
* Python runs only inside ``mapInArrow`` / ``applyInPandas`` tasks over batches that Spark deals out.
"""
