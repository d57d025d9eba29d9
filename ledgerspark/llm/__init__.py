"""Operations of a training-data pipeline: tokens, languages, packing, filters, duplicates, secrets.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
