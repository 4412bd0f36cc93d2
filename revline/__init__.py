"""revline: code-review analytics on Spark.

Entry points: ``revline.plans.review.review`` (the whole review as one plan), the operators in
``revline.operators`` (DataFrame → DataFrame), ``python -m revline review PATH`` (command line).
"""

__version__ = "0.1.0"
