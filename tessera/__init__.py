"""tessera: dense space-time panels, covariates, features, models and
grouped metrics as lazy Spark DataFrame jobs."""

__version__ = "0.1.0"
