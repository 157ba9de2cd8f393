"""Plan fragments that the operators share: features, sums over partitions, moments, Gram matrices, positions, neighbours."""
