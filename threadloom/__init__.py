"""Bulk analysis and compaction of conversation context on Spark.

A *thread* is one conversation: rows sharing ``thread_id``, ordered by ``msg_idx``.
Every operator takes and returns DataFrames and works on all threads at once.
"""
