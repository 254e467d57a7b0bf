"""wavequarry: Spark operators for corpora of sensor signals and labelled frames."""
