"""Sources, transforms, processing, likelihoods and evidence over tables of cells (recording_id, time_idx, freq_idx, ...)."""
