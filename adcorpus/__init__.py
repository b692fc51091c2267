"""adcorpus: build, prepare and score corpora of classified ads with Spark DataFrames."""

__version__ = "0.1.0"
