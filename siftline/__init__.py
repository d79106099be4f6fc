"""Repository-evidence analytics on Spark: what is new, what is referenced, what must never be touched, and how strong the evidence is.

``functions`` are Column expressions, ``sources`` read logs, baselines and trees, ``operators`` are DataFrame-to-DataFrame steps, ``plans``
put them together, ``streaming`` runs the ratchet over a stream. "No data" and "zero" are never the same value.
"""
