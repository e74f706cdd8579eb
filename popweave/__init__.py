"""popweave: population-genomics tables as Spark DataFrames, with a corpus-preparation subpackage."""
