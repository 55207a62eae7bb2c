"""DataFrame -> DataFrame operators: tidy, pivot, binning, time series, summaries."""
