"""postlens: Spark-native classification of short social-media text.

Everything is expressed with the DataFrame / SQL API so Catalyst can prune,
push down and code-generate it; MLlib supplies the learners and Structured
Streaming the incremental path.

Sub-packages:

- ``sources``   readers, writers and model persistence
- ``functions`` Column expressions (tokenizer, normalizers, TF-IDF analyzer, math)
- ``operators`` DataFrame operators (null policy, splits, vocabulary / TF-IDF,
                encoding, stacking, models, batching, metrics, statistics)
- ``plans``     end-to-end jobs (preprocess, sparse branch, stacked ensemble)
                and the query catalogue used by ``__spark_entry__``
- ``streaming`` tokenizing and scoring on streams
"""

__version__ = "0.1.0"
