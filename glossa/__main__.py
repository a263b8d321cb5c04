from glossa.plans.run import main

raise SystemExit(main())
