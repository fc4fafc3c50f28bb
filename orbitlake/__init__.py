"""orbitlake: nonlinear dynamics and time-series analytics as Spark jobs."""
