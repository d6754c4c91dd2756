"""capgraph: graph analytics and capacity analysis as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver except scalar convergence
signals inside iterative graph algorithms.
"""

__version__ = "0.1.0"
