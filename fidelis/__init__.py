"""fidelis: report-fidelity jobs as Spark DataFrame transformations."""
