"""DataFrame -> DataFrame operators.

clean       B1-B16  column and row cleaning
combine     C1-C3   joins, consecutive row index, positional merge
stats       D1-D11  one-pass statistics, exact quantiles
sampling    E1-E7   duplicates, set operations, sampling, balancing, generators
features    F1-F11  bins, vectors, scaling, PCA, projections, indexers
clustering  G1-G12  k-means, inertia, silhouette, gap statistic, choice of k
classify    H1-H8   tree classifiers, chains, grids, cross-validation
metrics     I1-I9   confusion-matrix metrics, weighted F1, AUROC, score tables
"""
