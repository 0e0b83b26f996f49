"""Training-data operators: token output, quality, chat formatting, licence scan,
decontamination, archives, byte-level BPE, URL rules and near-duplicates.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
