from terrapane.plans.cli import main

raise SystemExit(main())
