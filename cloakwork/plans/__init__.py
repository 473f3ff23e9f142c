"""What is to be found and how it is masked: types, strategies, profiles, systems, and the engine over them."""
